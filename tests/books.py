"""Small books for the tests: entries as tuples, and their expected forms."""

ROW = "book_id long, seq long, comment string, content string, ord long, position int, depth int"


def book(spark, entries, book_id=1):
    """entries: (comment, content, order, position, depth)."""
    return spark.createDataFrame([(book_id, i, *e) for i, e in enumerate(entries)], ROW)


def step(df, *cols):
    return [tuple(r) for r in df.orderBy("book_id", "seq").select(*cols).collect()]


LIGHTHOUSE = [
    ("harbour", "The harbour freezes in winter.", 12, 1, 4),
    ("lamp", "The lamp burns whale oil.", 5, 4, 12),
    ("weather", "Wind: <%= getvar('wind') %>", 3, 4, 2),
    ("keeper", "<Keeper>\n# History\nMara kept the light for years.\n# Mood\nNow: {{getvar::mood}}\n</Keeper>", 40, 1, 4),
    ("rope", "Rope is coiled by the door.", 2, 4, 3),
    ("dog", "The dog is old.", 1, 4, 3),
    ("storm", "<% if (storm) { %># Storm\nClose the shutters<% } else { %># Calm\nOpen them<% } %>", 30, 0, 4),
    ("clock", "It is {{time}}.", 31, 4, 20),
    ("cellar", "The cellar floods.", 9, 4, 30),
    ("stairs", "Ninety stairs.", 50, 0, 4),
    ("open", "<Night>", 60, 6, 4),
    ("tide", "Tide {{roll 6}}", 61, 6, 4),
    ("shut", "</Night>", 62, 6, 4),
]

#: Traced by hand: seq, position, depth, role, constant, key, comment, content.
#: Still text: deep at position 4 first (30 before 12), then positions 0, 1 and 6, then shallow at position 4 by order.
#: What moves stands in the wrapper: deep, then positions 0, 1 and 6 with the night's copies, then shallow.
LIGHTHOUSE_RESULT = [
    (0, 4, 9999, 1, True, [], "合并:0-1", "The cellar floods.\n\nThe lamp burns whale oil."),
    (1, 0, 4, None, True, [], "stairs", "Ninety stairs."),
    (2, 1, 4, None, True, [], "合并:3-4", "The harbour freezes in winter.\n\n<Keeper>\n# History\nMara kept the light for years.\n\n</Keeper>"),
    (3, 6, 4, None, True, [], "合并:5-6", "<Night>\n\n</Night>"),
    (4, 4, 0, 1, True, [], "合并:7-8", "The dog is old.\n\nRope is coiled by the door."),
    (5, 4, 0, 1, False, ["/.*/"], "[supplement-start]", "<补充内容>"),
    (6, 4, 0, 1, False, [], "clock", "It is {{time}}."),
    (7, 4, 0, 1, False, [], "storm", "<% if (storm) { %># Storm\nClose the shutters<% } else { %># Calm\nOpen them<% } %>"),
    (8, 4, 0, 1, False, [], "keeper [split-dynamic]", "<Keeper>\n# Mood\nNow: {{getvar::mood}}\n\n</Keeper>"),
    (9, 4, 0, 1, False, ["/.*/"], "open [boundary-copy-open]", "<Night>"),
    (10, 4, 0, 1, False, [], "tide", "Tide {{roll 6}}"),
    (11, 4, 0, 1, False, ["/.*/"], "shut [boundary-copy-close]", "</Night>"),
    (12, 4, 0, 1, False, [], "weather", "Wind: <%= getvar('wind') %>"),
    (13, 4, 0, 1, False, ["/.*/"], "[supplement-end]", "</补充内容>"),
]
