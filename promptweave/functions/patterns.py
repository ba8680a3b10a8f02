"""Fixed values of the prompt-entry format, and the character classes that its patterns are written with.

The patterns are valid for Java's and RE2's regular expressions alike, so that a second engine can check results.
"""

#: Characters of a tag or identifier name.
NAME = r"[\p{L}\p{N}_]"
#: White space, Unicode's included.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
#: What ends a line.
SEPS = r"\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
#: One line with its end.
LINE = rf"[^{SEPS}]*(?:\r\n|[{SEPS}])|[^{SEPS}]+"

# Markers that make an entry dynamic, in the order in which they are reported.
MARKERS = [
    ("<% if", rf"<%[-_]?{WS}*if($|[^\p{{L}}\p{{N}}_])"),
    ("<%=", r"<%="),
    ("<%-", r"<%-"),
    ("<%", r"<%([^-=#]|$)"),
    ("{{getvar::", r"\{\{getvar::"),
    ("{{setvar::", r"\{\{setvar::"),
    ("{{incvar::", r"\{\{incvar::"),
    ("{{xbgetvar_yaml_idx::", r"\{\{xbgetvar_yaml_idx::"),
    ("{{if", r"\{\{if($|[^\p{L}\p{N}_])"),
    ("{{.", r"\{\{\."),
    ("{{$", r"\{\{\$"),
    ("getvar(", r"(^|[^\p{L}\p{N}_])getvar\("),
    ("setvar(", r"(^|[^\p{L}\p{N}_])setvar\("),
    ("variables.", r"(^|[^\p{L}\p{N}_])variables\."),
    ("{{time}}", r"\{\{time\}\}"),
    ("{{date}}", r"\{\{date\}\}"),
    ("{{idleDuration}}", r"\{\{idleDuration\}\}"),
    ("{{random", r"\{\{random($|[^\p{L}\p{N}_])"),
    ("{{roll", r"\{\{roll($|[^\p{L}\p{N}_])"),
    ("{{format_message_variable", r"\{\{format_message_variable($|[^\p{L}\p{N}_])"),
    ("{{input}}", r"\{\{input\}\}"),
    ("{{lastMessage}}", r"\{\{lastMessage\}\}"),
    ("{{lastMessageId}}", r"\{\{lastMessageId\}\}"),
    ("{{lastUserMessage}}", r"\{\{lastUserMessage\}\}"),
    ("{{lastCharMessage}}", r"\{\{lastCharMessage\}\}"),
    ("{{bias", r"\{\{bias($|[^\p{L}\p{N}_])"),
    ("{{inject", r"\{\{inject"),
    ("<state>", r"<state>"),
]


def _starting(start: str) -> str:
    """Any of the markers whose pattern starts so, which is tried only where the start stands."""
    return f"{start}(?:{'|'.join(p.removeprefix(start) for _, p in MARKERS if p.startswith(start))})"


#: Any of them, by how they start: strings without one of which no marker can match, and a pattern.
MARKER_STARTS = [
    (["<%"], _starting("<%")),
    (["{{"], _starting(r"\{\{")),
    (["getvar(", "setvar(", "variables."], _starting(r"(^|[^\p{L}\p{N}_])")),
    (["<state>"], _starting("<state>")),
]

# Comment prefixes and content decorators of special plugins.
PLUGIN_COMMENTS = ["[GENERATE:BEFORE]", "[GENERATE:AFTER]", "[RENDER:BEFORE]", "[RENDER:AFTER]", "[InitialVariables]"]
PLUGIN_COMMENT_START = "@INJECT"
PLUGIN_DECORATORS = [
    "@@activate", "@@dont_activate", "@@generate_before", "@@generate_after", "@@render_before", "@@render_after", "@@preprocessing",
    "@@if", "@@private", "@@iframe", "@@message_formatting", "@@dont_preload", "@@always_enabled", "@@only_preload",
]

# Names that look like tags but are none.
NOT_TAGS = [
    "user", "char", "model", "group", "original", "br", "hr", "img", "input", "link", "meta", "span", "div", "p", "b", "i", "a",
    "content", "WritingStyle", "Variable_Format", "Update", "Update_Analysis", "json_patch", "status_current_variable", "Variable_Rules",
]

# Suffixes and comments that derived entries carry.
SPLIT_STATIC, SPLIT_DYNAMIC = "[split-static]", "[split-dynamic]"
COPY_OPEN, COPY_CLOSE, COPY = "[boundary-copy-open]", "[boundary-copy-close]", "[boundary-copy-"
SUPPLEMENT_START, SUPPLEMENT_END, SUPPLEMENT = "[supplement-start]", "[supplement-end]", "[supplement-"
MERGED = "合并:"
WRAPPER_NAME = "补充内容"
ALWAYS_KEY = "/.*/"
OPEN_WORDS, CLOSE_WORDS = ["开始", "start", "begin"], ["结束", "end", "close"]
ROLE_LABELS = {"user": "用户", "assistant": "角色", "system": "系统"}
TEMP_FIELDS = ["_is_static", "_original_order", "_is_boundary_copy", "_is_supplement", "_pair_id"]

#: An opening sign of an embedded code block.
CODE_OPEN = r"<%[-_=#]?"
#: A heading of level one or two that starts a segment.
HEADING = rf"^(#{{1,2}}){WS}+(.+?)($|\n)"
#: A heading that opens or closes a passage.
MD_BOUNDARY = rf"^(#{{1,2}}){WS}+(.+?)(开始|结束|start|end|begin|close){WS}*$"
#: String literals and comments of embedded code.
CODE_LITERALS = (
    r"(?s)'(?:\\.|[^'\\])*(?:'|\\?\z)"
    r'|"(?:\\.|[^"\\])*(?:"|\\?\z)'
    r"|`(?:\\.|[^`\\])*(?:`|\\?\z)"
    r"|//[^\n]*|/\*.*?(?:\*/|\z)"
)
