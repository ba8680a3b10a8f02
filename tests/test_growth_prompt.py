"""the parts of a prompt are joined range by range."""

import random

from promptweave.plans import prompt


def test_prompt_text_by_ranges(spark):
    rng = random.Random(4)
    rows = [(b, rng.randint(1, 14), rng.randint(-3, 0), rng.randint(-1, 1), i, rng.randint(0, 1), rng.choice(["", "x", "y\n", f"t{i}", None])) for b in range(3) for i in range(200)]
    rows += [(7, 1, 0, 1, 0, 1, None)]
    parts = spark.createDataFrame(rows, "book_id long, section int, part_group long, part_kind int, part_rn long, part_line int, text string").repartition(4)
    told = prompt.prompt_text(parts)
    assert "_range" in told._jdf.queryExecution().analyzed().toString()
    want = {b: "\n".join(r[6] for r in sorted(x for x in rows if x[0] == b and x[6] is not None)) for b in {r[0] for r in rows}}
    assert {r.book_id: r.text for r in told.collect()} == want
