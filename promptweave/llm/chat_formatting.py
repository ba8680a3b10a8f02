"""Chat formatting: records of many layouts to canonical turns, and turns to one template with a loss mask.

A record's layout is told by a fingerprint, the hash of the nested field paths it fills; a registry of declarative
mappings turns each known fingerprint into turns (role, text).  Everything is row by row in DataFrame functions.

Defined results: paths that no mapping names do not count, so further columns, also of clashing names or other types, change
nothing; a record whose fingerprint no mapping has keeps layout and turns null and is formatted as no turns; null texts
and roles are empty; an empty list is no turns.  Spark's limit of 2 GB a value holds for a formatted record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from .common import free_name

TURNS = "array<struct<role:string,text:string>>"

# Mappings


@dataclass(frozen=True)
class Listed:
    """Turns as a list: `items`, with fields for role and text (`text` may lead through one inner list, as parts[].text,
    whose texts are joined); `names` translates roles."""

    name: str
    items: str
    role: str
    text: str
    names: dict[str, str] = field(default_factory=dict)

    def required(self) -> list[str]:
        return [f"{self.items}[]"]

    def optional(self) -> list[str]:
        inner = [self.text.split(".")[0]] if "[]" in self.text else []
        return [f"{self.items}[].{x}" for x in (self.role, *inner, self.text)]

    def turns(self) -> Column:
        def text(x: Column) -> Column:
            if "[]." not in self.text:
                return x[self.text]
            parts, leaf = self.text.split("[].")
            return F.array_join(F.transform(x[parts], lambda p: F.coalesce(p[leaf], F.lit(""))), "")

        def role(x: Column) -> Column:
            named = F.lit(None).cast("string")
            for theirs, ours in self.names.items():
                named = F.coalesce(named, F.when(x[self.role] == theirs, ours))
            return F.coalesce(named, x[self.role], F.lit(""))

        return F.transform(_column(self.items), lambda x: F.struct(role(x).alias("role"), F.coalesce(text(x), F.lit("")).alias("text")))


@dataclass(frozen=True)
class Fielded:
    """Turns as fields of the record: (role, fields joined by blank lines where they are not empty), in order.  A turn
    whose fields are all optional and not there is left out."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]
    maybe: tuple[str, ...] = ()

    def required(self) -> list[str]:
        return [f for _, fields in self.parts for f in fields if f not in self.maybe]

    def optional(self) -> list[str]:
        return list(self.maybe)

    def turns(self) -> Column:
        made = []
        for role, fields in self.parts:
            if len(fields) == 1:
                text = F.coalesce(_column(fields[0]), F.lit(""))
            else:
                text = F.array_join(F.filter(F.array(*map(_column, fields)), lambda x: x != ""), "\n\n")
            there = F.lit(True) if set(fields) - set(self.maybe) else F.coalesce(*map(_column, fields)).isNotNull()
            made.append(F.when(there, F.struct(F.lit(role).alias("role"), text.alias("text"))))
        return F.array_compact(F.array(*made))


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


#: The layouts known; of those that one fingerprint fits the first holds.
MAPPINGS: tuple[Listed | Fielded, ...] = (
    Listed("messages", "messages", "role", "content"),
    Listed("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Listed("contents", "contents", "role", "parts[].text", {"model": "assistant"}),
    Fielded("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Fielded("prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    Fielded("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    Fielded("question_answer", (("user", ("question",)), ("assistant", ("answer",)))),
)


def _paths(kind: DataType, value: Column, path: str) -> Iterator[tuple[str, str, Column]]:
    """(path, type, whether the record fills it) of a field and all below it; lists are walked with []."""
    if isinstance(kind, ArrayType):
        yield f"{path}[]", "list", value.isNotNull()
        if isinstance(kind.elementType, StructType):
            for f in kind.elementType.fields:
                # The path's test is built for one element; `exists` asks it of all.
                for at, of, _ in _paths(f.dataType, F.lit(None), f"{path}[].{f.name}"):
                    steps = at[len(path) + 3 :]
                    yield at, of, F.coalesce(_fills(value, steps), F.lit(False))
    elif isinstance(kind, StructType):
        for f in kind.fields:
            yield from _paths(f.dataType, value[f.name], f"{path}.{f.name}")
    else:
        yield path, kind.simpleString(), value.isNotNull()


def _fills(items: Column, steps: str) -> Column:
    """Whether any element of a list fills the path below it."""
    head, found, rest = steps.partition("[]")
    if found and rest:
        return F.exists(items, lambda x: F.coalesce(_fills(_at(x, head), rest[1:]), F.lit(False)))
    return F.exists(items, lambda x: _at(x, head).isNotNull())


def _at(x: Column, dotted: str) -> Column:
    for name in dotted.split("."):
        x = x[name]
    return x


def _fingerprint_of(paths: list[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def _fitting(records: DataFrame, mappings: tuple[Listed | Fielded, ...]) -> tuple[dict[str, Column], list[Listed | Fielded]]:
    """The paths that mappings name and the table has, of the right type, with their tests; and the mappings that all
    of whose paths are among them."""
    held: dict[str, Column] = {}
    for f in records.schema.fields:
        held |= {path: test for path, kind, test in _paths(f.dataType, _column(f.name), f.name) if kind == ("list" if path.endswith("[]") else "string")}
    fit = [m for m in mappings if {*_required(m), *_leaves(m)} <= set(held)]
    named = {p for m in fit for p in (*_required(m), *_optional(m, held))}
    return {p: held[p] for p in sorted(named)}, fit


def _required(m: Listed | Fielded) -> list[str]:
    return m.required()


def _leaves(m: Listed | Fielded) -> list[str]:
    return [] if isinstance(m, Fielded) else [p for p in m.optional() if p.rsplit("[].", 1)[-1] in (m.role, m.text.rsplit("[].", 1)[-1])]


def _optional(m: Listed | Fielded, held: dict[str, Column]) -> list[str]:
    out = []
    for p in m.optional():
        out += [x for x in (p, f"{p}[]") if x in held]
    return out


def fingerprint(records: DataFrame, mappings: tuple[Listed | Fielded, ...] = MAPPINGS) -> Column:
    """Hash of the sorted nested field paths, of those that mappings name, that a record fills."""
    held, _ = _fitting(records, mappings)
    return F.xxhash64(F.concat_ws("\n", F.array_compact(F.array(*[F.when(test, F.lit(p)) for p, test in held.items()]))))


def canonical(records: DataFrame, mappings: tuple[Listed | Fielded, ...] = MAPPINGS) -> DataFrame:
    """records with fingerprint, layout (a mapping's name) and turns (array of role, text)."""
    held, fit = _fitting(records, mappings)
    if not fit:
        none = {"fingerprint": F.xxhash64(F.lit("")), "layout": F.lit(None).cast("string"), "turns": F.lit(None).cast(TURNS)}
        return records.withColumns(none)
    mark = free_name(records, "_fp")
    rows = records.withColumn(mark, fingerprint(records, mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(fit):
        some = _optional(m, held)
        known = [_fingerprint_of([*_required(m), *extra]) for n in range(len(some) + 1) for extra in combinations(some, n)]
        mine = F.col(mark).isin(*known)
        layout, turns = F.when(mine, m.name).otherwise(layout), F.when(mine, m.turns()).otherwise(turns)
    return rows.withColumns({"layout": layout, "turns": turns}).withColumn("fingerprint", F.col(mark)).drop(mark)


# Template

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What must not stand in a formatted text but as the template's own: its marks and those of other common templates.
#: No end of one is the beginning of another, so that they never overlap.
CONTROL = (START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"


def _control_pattern() -> str:
    """The first character of a control string, as group 1 or 2."""
    heads: dict[str, list[str]] = {}
    for c in CONTROL:
        heads.setdefault(c[0], []).append(c[1:])
    return "|".join(f"({re.escape(h)})(?={'|'.join(map(_quoted, rests))})" for h, rests in heads.items())


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def escaped(text: Column) -> Column:
    """text without control strings: a backslash stands before each backslash and after a control string's first sign."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _control_pattern(), r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(records: DataFrame) -> DataFrame:
    """records (turns) with formatted, the template's text; segments, its parts, one a turn; and loss, for each segment
    the code points from start up to end that are trained on, null where none are: the texts of assistants.

    A mask by segment keeps reading it linear; add the lengths of the segments before for places in the whole text."""
    parts = F.transform(
        F.coalesce("turns", F.array().cast(TURNS)),
        lambda t: F.struct(F.concat(F.lit(START), escaped(F.coalesce(t["role"], F.lit(""))), F.lit(MIDDLE)).alias("head"), escaped(F.coalesce(t["text"], F.lit(""))).alias("body"), F.coalesce(t["role"] == TRAINED, F.lit(False)).alias("trained")),
    )
    names = [free_name(records, n) for n in ("_parts",)]
    rows = records.withColumn(names[0], parts)
    segments = F.transform(names[0], lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    loss = F.transform(names[0], lambda p: F.when(p["trained"], F.struct(F.length(p["head"]).alias("start"), (F.length(p["head"]) + F.length(p["body"])).alias("end"))))
    return rows.withColumns({"segments": segments, "loss": loss}).withColumn("formatted", F.array_join("segments", "")).drop(names[0])


def turns_read(text: Column) -> Column:
    """The turns of a formatted text: what stands between the template's marks, unescaped."""
    pieces = F.split(text, _quoted(START))
    cut = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.split(p, f"{_quoted(MIDDLE)}|{_quoted(END)}"))
    return F.transform(cut, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def trained_texts(segments: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped, a string for each masked segment."""
    both = F.filter(F.arrays_zip(segments.alias("s"), loss.alias("m")), lambda x: x["m"].isNotNull())
    return F.transform(both, lambda x: unescaped(F.substring(x["s"], x["m"]["start"] + 1, x["m"]["end"] - x["m"]["start"])))


# The query

#: The conversation that the contract adds.
_ADDED = "</s>[INST] ok [/INST]"


def as_records(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> a record per conversation, in one of the layouts; which, its roles and a checksum of
    its id decide.  Turns of one number stand by role, then text.  Partial lists are built before the shuffle."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    rows = rows.withColumns({"roles": F.transform("all", lambda x: x["role"]), "kind": F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 3})

    def roles_are(*names: str) -> Column:
        return F.col("roles") == F.array(*map(F.lit, names))

    def text(i: int) -> Column:
        return F.get("all", F.lit(i))["text"]

    pair, led, kind = roles_are("user", "assistant"), roles_are("system", "user", "assistant"), F.col("kind")
    plain = F.forall("roles", lambda r: r.isin("user", "assistant", "system"))
    layout = (
        F.when(pair & (kind == 0), "prompt_response").when(pair & (kind == 1), "instruction").when(led & (kind == 0), "prompt_response")
        .when(plain & (kind == 1), "conversations").when(plain & (kind == 2), "contents").otherwise("messages")
    )
    rows = rows.withColumn("as", layout)

    def where(name: str, value: Column) -> Column:
        return F.when(F.col("as") == name, value)

    def listed(names: dict[str, str], make) -> Column:
        return F.transform("all", lambda x: make(F.coalesce(*[F.when(x["role"] == k, v) for k, v in names.items()], x["role"]) if names else x["role"], x["text"]))

    asked, told = F.when(led, text(1)).otherwise(text(0)), F.when(led, text(2)).otherwise(text(1))
    return rows.select(
        "conv_id",
        where("messages", listed({}, lambda r, t: F.struct(r.alias("role"), t.alias("content")))).alias("messages"),
        where("conversations", listed({"user": "human", "assistant": "gpt"}, lambda r, t: F.struct(r.alias("from"), t.alias("value")))).alias("conversations"),
        where("contents", listed({"assistant": "model"}, lambda r, t: F.struct(r.alias("role"), F.array(F.struct(t.alias("text"))).alias("parts")))).alias("contents"),
        where("prompt_response", F.when(led, text(0))).alias("system"),
        where("prompt_response", asked).alias("prompt"),
        where("prompt_response", told).alias("response"),
        where("instruction", asked).alias("instruction"),
        where("instruction", F.lit("")).alias("input"),
        where("instruction", told).alias("output"),
    )


def digests(records: DataFrame) -> DataFrame:
    """What the contract asks of records (conv_id and a layout's fields), read back from the formatted text and mask."""
    rows = formatted(canonical(records)).select("conv_id", "formatted", turns_read(F.col("formatted")).alias("again"), trained_texts(F.col("segments"), F.col("loss")).alias("trained"))
    told = F.array_join(F.transform("again", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return rows.select(
        "conv_id", F.size("again").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")  # a shuffle follows, so its partitions are as they are
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{_ADDED}'), (-1L, 1L, 'assistant', '{_ADDED}') AS t(conv_id, turn, role, text)")
    return digests(as_records(turns.unionByName(added)))


def _sql_escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_ORDER = "ORDER BY turn, role, text"
OP12_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_ADDED}'), (-1, 1, 'assistant', '{_ADDED}'))
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + {len(START + MIDDLE + END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
