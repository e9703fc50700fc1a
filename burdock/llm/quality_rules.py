"""Quality rules: statistics of a text's own words and lines, and how often its lines stand in other documents.

Base rules fail texts of few words and texts whose three-word windows repeat. The line rule then counts, for every
normalised line (A-Z in lower case, runs of digits as 0, white space as single spaces; lines without a word are left
out), the distinct documents of its host that hold it. Lines in more than ``limit`` documents of a host are removed, and a
document is rejected as depleted if less than ``share`` percent of its words are left.

One Arrow pass reads the texts; what it keeps of a row (its counts, and hash and words of each of its distinct lines)
is written to the shared folder, and all that follows reads this small table. Documents of a line are counted as
(line, document) pairs and then as sums, so a line that stands in a third of all rows is no task's own. The frequent
lines are broadcast if a count proves them few; else both sides are salted, so that such a line is met in ``SALTS``
places.

A host is a value of ``host_col``; null is a host of its own. Rows that repeat an id are one document in the counts; a
row without an id is a document of its own text. Null text has no words and fails the base rules, as an empty one does; very long texts
count whole. Repeated rows get the same verdict each; an empty table gives no rows; extra columns are ignored. Lines
are told apart by 64-bit hashes that hold the host, rows by 128-bit hashes of id, host and text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LIMIT, SHARE = 10, 50
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Frequent lines that are broadcast at most, and the places that one of them is dealt to where there are more.
FEW, SALTS = 200_000, 32
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_DIGITS = re.compile(rb"[0-9]+")
_ROW = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, document long, row binary, lines array<long>, words array<long>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    x = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    pairs = np.unique(x[:-1] * len(codes) + x[1:], return_inverse=True)[1].astype(np.int64)
    _, place, count = np.unique(pairs[:-1] * len(codes) + x[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def normal(line: bytes) -> bytes:
    """A line as it is compared."""
    return b" ".join(_DIGITS.sub(b"0", line.lower()).split())


def _line_hash(line: bytes, host: str | None) -> int:
    """Signed 64-bit hash of a normalised line and its host."""
    seed = 0 if host is None else xxhash.xxh64_intdigest(host.encode(), 1)
    return xxhash.xxh64_intdigest(line, seed) - (1 << 63)


def _row(id_col: str, host_col: str, text_col: str) -> Column:
    """128 bits of id, host and text, as a key of equal rows."""
    own = lambda c, absent: F.coalesce(F.col(c).cast("string"), F.lit(absent))
    return F.unhex(F.md5(F.concat_ws("\0", own(id_col, "\1"), own(host_col, "\1"), own(text_col, "")).cast("binary")))


def measured(row: bytes, key: str | None, host: str | None, text: str | None) -> tuple:
    """The cells of ``_ROW`` of one row."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at the same six characters as the rule
    seen: set[bytes] = set()
    held: dict[int, int] = {}
    n_dup = 0
    for line in raw.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        n_dup += line in seen
        seen.add(line)
        h = _line_hash(normal(line), host)
        held[h] = held.get(h, 0) + n
    document = int.from_bytes(row[:8], "little", signed=True) if key is None else xxhash.xxh64_intdigest(key.encode()) - (1 << 63)
    return len(words), len(text) - len(_SPACE.findall(text)), sum(map(text.count, SYMBOLS)), n_dup, repeated(words), document, row, list(held), list(held.values())


def measure(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base statistics, and what the line rule needs of each row: document, row, lines, words."""
    common.tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), _row(id_col, host_col, text_col).alias("__row"), F.col(id_col).cast("string").alias("__key"), F.col(host_col).cast("string").alias("__host"), F.col(text_col).cast("string").alias("__text"))
    types = [pa.int64()] * 6 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        for b in batches:
            cells = [measured(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
            cols = list(zip(*cells, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["__id", *(x.split()[0] for x in _ROW.split(", "))])

    return rows.mapInArrow(common.lean(run), f"__id {kind}, {_ROW}").withColumnRenamed("__id", id_col)


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("row", "document", F.explode(F.arrays_zip("lines", "words")).alias("x")).select("row", "document", F.col("x.lines").alias("line"), F.col("x.words").alias("words"))


def frequent(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """line, n_docs of the lines that stand in more than ``limit`` documents of their host; ``rows`` as from ``measure``."""
    return _lines(rows).groupBy("line").agg(F.count_distinct("document").alias("n_docs")).where(F.col("n_docs") > limit)


def removals(rows: DataFrame, often: DataFrame, few: int = FEW) -> DataFrame:
    """row, removed_words, removed (hashes) of the rows that hold frequent lines."""
    lines, often = _lines(rows), often.select("line")
    if often.limit(few + 1).count() <= few:
        met = lines.join(F.broadcast(often), "line", "left_semi")
    else:
        dealt = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(dealt, ["line", "salt"], "left_semi")
    once = met.groupBy("row", "line").agg(F.max("words").alias("words"))  # repeated rows share a key
    return once.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))


def judge(docs: DataFrame, limit: int = LIMIT, share: int = SHARE, few: int = FEW, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base statistics, removed_words, base_failed, kept, row, removed (hashes of the lines to take out) of each row."""
    ws = common.Workspace(docs.sparkSession)
    rows = ws.save(measure(docs, host_col, id_col, text_col), "rows")
    often = ws.save(frequent(rows, limit), "frequent")
    gone = removals(rows, often, few)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    out = rows.drop("lines", "words", "document").join(gone, "row", "left").withColumns({"removed_words": removed, "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("removed_words")) >= share * F.col("n_words"))).select(id_col, *BASE, "removed_words", "base_failed", "kept", "row", "removed")


def without(text: str, host: str | None, gone: set[int]) -> str:
    """The text less the lines with such a hash."""
    return "\n".join(x for x in text.split("\n") if _line_hash(normal(x.encode()), host) not in gone)


def clean(docs: DataFrame, limit: int = LIMIT, share: int = SHARE, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows with all their columns, frequent lines taken out of their texts."""
    verdict = judge(docs, limit, share, FEW, host_col, id_col, text_col).where("kept").select(F.col("row").alias("__row"), F.col("removed").alias("__removed")).dropDuplicates(["__row"])
    names, kinds = docs.columns, docs.schema
    both = docs.withColumn("__row", _row(id_col, host_col, text_col)).join(verdict, "__row").select(*names, "__removed")
    at, host = names.index(text_col), names.index(host_col)

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            texts = [without(t, h, set(gone)) if gone else t for t, h, gone in zip(*(cols[i].to_pylist() for i in (at, host, -1)), strict=True)]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols[:-1], names=names)

    return both.mapInArrow(common.lean(run), kinds)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("row", "removed")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
k AS (SELECT r, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS m FROM k WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE m > 1) GROUP BY 1),
l AS (SELECT r, coalesce(doc_id::VARCHAR, 'row ' || r) AS doc, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT *, unnest(string_split(t, chr(10))) AS line FROM d)),
e AS (SELECT *, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l WHERE n > 0),
often AS (SELECT source, norm FROM e GROUP BY 1, 2 HAVING count(DISTINCT doc) > 10),
gone AS (SELECT r, sum(n) AS n FROM e JOIN often ON e.norm = often.norm AND e.source IS NOT DISTINCT FROM often.source GROUP BY 1),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM e GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= 50 * n_words AS kept FROM s
"""
