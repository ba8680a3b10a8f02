"""PII: regular expressions propose, checksums confirm, nearby context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, small_batches

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
#: Score before context: how sure the pattern and its checksum alone make it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
#: Characters on both sides in which context words count, and what one of them adds.
REACH, BONUS = 40, 0.1

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can start in the midst of digits only where none starts at their beginning, and then none does: the
# look-behind changes no result and keeps long runs of digits linear.  Possessive runs likewise.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_WORD = regex.compile(r"\p{L}+(?:-\p{L}+)*")
_DIGIT = re.compile(r"[0-9]")

# Signs of a bank account number by country.
IBAN_SIGNS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of LOCAL+ @ DOMAIN: each has one at sign, before which its local part reaches back as far as it can."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


@lru_cache(None)
def _iban_shape(signs: int) -> re.Pattern:
    """So many signs, at most one blank before each group of four, and no sign after the last."""
    groups, rest = divmod(signs - 4, 4)
    return re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}" + rf"\x20?[A-Z0-9]{{{rest}}}" * (rest > 0) + "(?![A-Za-z0-9])")


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Every start is tried by itself, so no number hides behind another one's beginning; a try reads some forty signs."""
    for m in _IBAN.finditer(text):
        signs = IBAN_SIGNS.get(text[m.start() : m.start() + 2])
        found = signs and _iban_shape(signs).match(text, m.start())
        if found and mod97(found.group().replace(" ", "")):
            yield m.start(), found.end()


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, sorted."""
    text = text or ""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
        found += [(s, 4, e) for s, e in _ibans(text)]
    return sorted(found)


def score(text: str, start: int, kind: int, end: int) -> float:
    name = KINDS[kind]
    near = _WORD.findall((text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower())
    return min(1.0, PRIOR[name] + BONUS * len(set(near) & set(CONTEXT[name])))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "n_spans", "base_sha256", "spans", "scores"]
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            spans = find_spans(text)
            counts = [sum(k == n for _, k, _ in spans) for n in range(len(KINDS))]
            base = _listed([x for x in spans if x[1] < BASE])
            rows.append((*counts, len(spans), hashlib.sha256(base.encode()).hexdigest(), _listed(spans), ",".join(f"{score(text, *x):.2f}" for x in spans)))
        cols = list(zip(*rows)) if rows else [()] * len(names[1:])
        kinds = [pa.int64()] * (len(KINDS) + 1) + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_iban, n_spans, base_sha256, spans, scores.

    spans lists kind:start:end by start, then kind; scores lists their scores in that order.  base_sha256 is of the
    spans of the first four kinds.  Bank account numbers (iban) are what the method adds: of a known country, with that
    country's number of signs, blanks only between groups of four, no sign before or after, and the right check
    digits.  Null text counts as empty and has no spans; repeated rows are each returned; an empty table gives no rows.
    Map-only: no shuffle.
    """
    small_batches(docs.sparkSession)
    counts = ", ".join(f"n_{k} long" for k in (*KINDS, "spans"))
    return docs.select("doc_id", "text").mapInArrow(_span_batches, f"doc_id long, {counts}, base_sha256 string, spans string, scores string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))


# The twin states the patterns of the base kinds by themselves, as they were asked for.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[^A-Za-z0-9][A-Z]{2}[0-9]{2}",  # where one may start, with the sign before
}
_SQL_FITS = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0",
    "card": "length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INT) WHEN digits[-i] > '4' THEN CAST(digits[-i] AS INT) * 2 - 9 ELSE CAST(digits[-i] AS INT) * 2 END)) % 10 = 0",
    "phone": "length(digits) BETWEEN 10 AND 15",
}


def _spans_sql(kind: str) -> str:
    b, m = (f"regexp_extract_all(t, '(?s)(.*?)({_SQL_PATTERNS[kind]})', {g})" for g in (1, 2))
    at = "CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(all_m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) - 1"
    found = f"""SELECT doc_id, t, '{kind}' AS kind, {KINDS.index(kind)} AS k, {at} AS s, all_m[i] AS m, regexp_replace(all_m[i], '[^0-9]', '', 'g') AS digits
    FROM (SELECT *, unnest(range(1, len(all_m) + 1)) AS i FROM (SELECT doc_id, t, {b} AS b, {m} AS all_m FROM d))"""
    if kind != "iban":
        return f"SELECT doc_id, t, kind, k, s, s + length(m) AS e FROM ({found}) WHERE {_SQL_FITS[kind]}"
    shape = "'^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){' || ((signs - 4) // 4) || '}' || CASE WHEN signs % 4 > 0 THEN ' ?[A-Z0-9]{' || (signs % 4) || '}' ELSE '' END"
    turned = "list_concat(string_split(substr(code, 5), ''), string_split(substr(code, 1, 4), ''))"
    rest = f"list_reduce({turned}, lambda a, x: CAST(CASE WHEN x <= '9' THEN (CAST(a AS INT) * 10 + CAST(x AS INT)) % 97 ELSE (CAST(a AS INT) * 100 + ascii(x) - 55) % 97 END AS VARCHAR), '0')"
    return f"""SELECT doc_id, t, kind, k, s, e FROM (
    SELECT *, s + length(whole) AS e, replace(whole, ' ', '') AS code FROM (
      SELECT doc_id, t, kind, k, s + 1 AS s, regexp_extract(substr(t, s + 3, 50), {shape}) AS whole
      FROM ({found}) JOIN (VALUES {", ".join(f"('{c}', {n})" for c, n in IBAN_SIGNS.items())}) AS n(country, signs) ON substr(m, 2, 2) = country)
    ) WHERE whole <> '' AND NOT regexp_matches(substr(t, e + 2, 1), '[A-Za-z0-9]') AND {rest} = '1'"""


_BONUS_SQL = " ".join(
    f"WHEN '{k}' THEN {PRIOR[k]} + {BONUS} * len(list_filter([{', '.join(repr(w) for w in CONTEXT[k])}], lambda w: list_contains(near, w)))" for k in KINDS
)
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, ' ' || coalesce(text, '') AS t FROM documents), f AS (
{" UNION ALL ".join(map(_spans_sql, KINDS))}
), n AS (
  SELECT *, regexp_extract_all(lower(substr(t, greatest(s - {REACH}, 0) + 2, s - greatest(s - {REACH}, 0)) || ' ' || substr(t, e + 2, {REACH})), '\p{{L}}+(?:-\p{{L}}+)*') AS near FROM f
), g AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, count(*) AS n_spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {BASE}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
    string_agg(printf('%.2f', CAST(least(1.0, CASE kind {_BONUS_SQL} END) AS DOUBLE)), ',' ORDER BY s, k) AS scores
  FROM n GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*KINDS, "spans"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (doc_id)
"""
