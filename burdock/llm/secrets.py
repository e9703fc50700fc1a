"""Secret scans: an Aho-Corasick pass finds keywords, regular expressions are tried only where a keyword stands, and
tokens that carry a checksum are reported only if it holds.

Kinds: assign (a password-like name, a sign and a value of 6 or more characters), access (AKIA and capitals or digits,
20 or more), hex (24 or more lower-case hex digits in a row; it has no keyword, so its maximal runs are read off
directly), and with an embedded CRC32: github (gh?_ and 36 characters), npm (npm_ and 36 characters).

Matches of a kind are leftmost and do not overlap; one that is too short still uses up its characters. Spans are code
points, end exclusive. Null text is the empty text; very long texts are scanned whole. Repeated rows are scanned one by
one; spans that start together come in the order of the kinds; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
}
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)  # noqa: E731  ASCII letters only, unlike re.IGNORECASE
_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ANCHORED = {
    "assign": re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
}
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_automata: dict[int, object] = {}


def checksum(body: str) -> str:
    """The last six characters of such a token: base 62 of the CRC32 of what stands before them."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _DIGITS[digit] + out
    return out


def _keep(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    return checksum(m[1][:-6]) == m[1][-6:]


def automaton():
    if 0 not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _automata[0] = a
    return _automata[0]


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every secret in the whole text, sorted."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; then ASCII letters only, position by position
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    out, past = [], dict.fromkeys(KINDS, 0)
    for end, (kind, size) in automaton().iter(low):
        start = end - size + 1
        if start >= past[kind] and (m := ANCHORED[kind].match(text, start)):
            past[kind] = m.end()
            if _keep(kind, m):
                out.append((start, KINDS.index(kind), m.end()))
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    out, at, i = [], 0, 0
    while i < len(found):
        start, _, end = found[i]
        while i + 1 < len(found) and found[i + 1][0] < end:
            i += 1
            end = max(end, found[i][2])
        out += [text[at:start], mark]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (all kinds), n_assign, n_access, n_hex, base_sha256 of each row."""
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches):
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            base = [[x for x in f if x[1] < len(BASE)] for f in found]
            counts = [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(len(BASE))]
            digest = [hashlib.sha256(joined(f).encode()).hexdigest() for f in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest, pa.string()), pa.array([joined(f) for f in found], pa.string())], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(common.lean(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_rows(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, secrets replaced in the text; ``count_col`` follows the new length of changed texts."""
    common.tune(docs.sparkSession)
    names = docs.columns
    at, counted = names.index(text_col), names.index(count_col) if count_col in names else None

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            texts, changed = b.column(at).to_pylist(), {}
            for i, t in enumerate(texts):
                if found := find(t):
                    changed[i] = texts[i] = redact(t, found)
            if changed:
                cols[at] = pa.array(texts, b.schema.field(at).type)
                if counted is not None:
                    n = b.column(counted).to_pylist()
                    cols[counted] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(n)], b.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(common.lean(run), docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The scan in SQL. A match's place is what the text's pieces between the matches before it, and these, are long;
    the checksum is computed bit by bit."""
    hits = {
        "assign": (rf"({_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, "length(g) >= 6", "length(m)"),
        "access": (r"AKIA[A-Z0-9]+", 0, "length(m) >= 20", "length(m)"),
        "hex": (r"[0-9a-f]{24,}", 0, "true", "length(m)"),
        "github": (r"gh[pousr]_([A-Za-z0-9]{36})(?:[^A-Za-z0-9]|$)", 1, "sound", "40"),
        "npm": (r"npm_([A-Za-z0-9]{36})(?:[^A-Za-z0-9]|$)", 1, "sound", "40"),
    }
    raw = " UNION ALL ".join(f"SELECT r, {k} AS k, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS s FROM d" for k, (p, g, _, _) in enumerate(hits.values()))
    bits = "flatten(list_transform(range(1, 31), lambda i: [ascii(substr(g, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, o: CASE WHEN o < 0 THEN xor(c >> 1, (c & 1) * 3988292384::BIGINT) ELSE xor(c, o) END), 4294967295::BIGINT)"
    check = " || ".join(f"substr('{_DIGITS}', ((crc // {62**k}) % 62 + 1)::INT, 1)" for k in range(5, -1, -1))
    keep = " ".join(f"WHEN k = {k} THEN {rule}" for k, (_, _, rule, _) in enumerate(hits.values()))
    size = " ".join(f"WHEN k = {k} THEN {n}" for k, (*_, n) in enumerate(hits.values()))
    name = " ".join(f"WHEN k = {k} THEN '{kind}'" for k, kind in enumerate(hits))
    count = ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
each AS (SELECT r, k, m[i] AS m, g[i] AS g, list_sum(list_transform(s[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)),
sums AS (SELECT *, CASE WHEN k > 2 THEN {crc} END AS crc FROM each),
kept AS (SELECT r, k, CASE {name} END || ':' || a::BIGINT || ':' || (a + CASE {size} END)::BIGINT AS span, a FROM (SELECT *, substr(g, 31) = {check} AS sound FROM sums) WHERE CASE {keep} END),
found AS (SELECT r, {count}, string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (r)
"""


ORACLE = _sql()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced in the texts; every document stays."""
    return redact_rows(docs)
