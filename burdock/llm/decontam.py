"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

Texts are lower-cased (A-Z) and split into words of letters, digits and non-ASCII characters. Items of ``window`` or
more words count by their windows, shorter ones by the whole item. A document's words are streamed through the
automaton, which keeps the longest suffix matched so far; where that reaches a window, the window's words are hit.
A word no item has resets the automaton, so only stretches of known words long enough for a window are streamed.

A document is contaminated if hits cover a share of 1 / ``share`` of its words or more. Null and empty texts have no
words; very long texts are streamed whole; repeated rows are judged one by one; ties do not arise; extra columns pass
through (``__n_words``, ``__hits`` and ``__items`` are this module's); an empty table gives no rows; an empty benchmark
hits nothing; an item without an id counts under the empty id.

An automaton goes to the workers only for up to ``SHARD_CHARS`` of benchmark text: its states lie in integer arrays,
with a dictionary only where words branch. A larger benchmark is split by item, items of many words into pieces that
share all but one word of a window; the documents' texts are then read once for each automaton, but what is written is
the hits alone (by the text's digest), and they are joined back to the documents in the end.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 13
SHARE = 20
SHARD_CHARS = 8_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton over several word sequences; ``vocab`` numbers their words.

    Of a state's transitions the first lies in two integer arrays, ``word`` and ``goal``; ``more`` has the rest of the
    states that have several.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.word, self.goal, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.size = array("i", [-1]), array("i", [0])
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for name, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: The state that holds the suffix of ``window`` words, for each state that is long enough.
        self.full = array("i", (self._up(s) if self.size[s] >= window else -1 for s in range(len(self.size))))
        #: Items by the state of a window: the first one's number, and all of them where there are several.
        self.names = [name for name, _ in coded]
        self.owner, self.shared = array("i", [-1]) * len(self.size), {}
        shorts: dict[int, set] = {}
        for k, (name, ws) in enumerate(coded):
            s = 0
            for i, w in enumerate(ws):
                s = self._go(s, w)
                if i + 1 >= window:
                    f = self.full[s]
                    if self.owner[f] < 0:
                        self.owner[f] = k
                    elif self.owner[f] != k:
                        self.shared.setdefault(f, {self.names[self.owner[f]]}).add(name)
            if len(ws) < window:
                while self.size[self.link[s]] >= len(ws):
                    s = self.link[s]
                shorts.setdefault(s, set()).add((len(ws), name))
        #: Short items that end where a state ends, its links' included, shortest first.
        self.shorts: dict[int, list] = {}
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__) if shorts else ():
            if own := [*self.shorts.get(self.link[s], ()), *sorted(shorts.get(s, ()))]:
                self.shorts[s] = own
        self.least = min([window, *(len(ws) for _, ws in coded)])

    def _go(self, s: int, w: int) -> int:
        """The state behind ``s`` and ``w``; -1 if there is none."""
        if self.word[s] == w:
            return self.goal[s]
        return self.more[s].get(w, -1) if s in self.more else -1

    def _set(self, s: int, w: int, t: int) -> None:
        if self.word[s] in (-1, w):
            self.word[s], self.goal[s] = w, t
        else:
            self.more.setdefault(s, {})[w] = t

    def _up(self, s: int) -> int:
        while self.size[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def _new(self, size: int, link: int, word: int = -1, goal: int = -1) -> int:
        for cells, x in ((self.size, size), (self.link, link), (self.word, word), (self.goal, goal)):
            cells.append(x)
        return len(self.size) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.size[p] + 1, self.link[q], self.word[q], self.goal[q])
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p >= 0 and self._go(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if (q := self._go(last, w)) >= 0:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, w, q)
        cur, p = self._new(self.size[last] + 1, 0), last
        while p >= 0 and self._go(p, w) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p >= 0:
            q = self._go(p, w)
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        return cur

    def matches(self, ws: list[bytes]) -> tuple[np.ndarray, set]:
        """Positions of hit words, and the items whose windows occur."""
        n = len(ws)
        none = np.zeros(0, np.int32)
        if n < self.least or not self.vocab:
            return none, set()
        ids = np.fromiter(map(self.vocab.get, ws, repeat(-1)), np.int32, n)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.least
        if not long.any():
            return none, set()
        cover, found = None, set()
        word, goal, more, link, size, full, window = self.word, self.goal, self.more, self.link, self.size, self.full, self.window
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            s = have = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while (t := goal[s] if word[s] == w else more[s].get(w, -1) if s in more else -1) < 0:
                    s = link[s]
                    if s < 0:
                        break
                    have = size[s]
                if t < 0:
                    s = have = 0
                    continue
                s, have = t, have + 1
                if have >= window:
                    cover = np.zeros(n + 1, np.int32) if cover is None else cover
                    cover[i + 1 - window] += 1
                    cover[i + 1] -= 1
                    found.add(self.names[self.owner[full[s]]])
                    if full[s] in self.shared:
                        found |= self.shared[full[s]]
                for length, name in self.shorts.get(s, ()):
                    if length <= have:
                        cover = np.zeros(n + 1, np.int32) if cover is None else cover
                        cover[i + 1 - length] += 1
                        cover[i + 1] -= 1
                        found.add(name)
        if cover is None:
            return none, found
        return np.flatnonzero(np.cumsum(cover[:-1]) > 0).astype(np.int32), found


def pieces(ws: list[bytes], most: int, window: int = WINDOW) -> Iterator[list[bytes]]:
    """``ws`` in pieces of about ``most`` characters that share ``window`` - 1 words, so each window lies whole in one."""
    at = 0
    while True:
        end, size = at, 0
        while end < len(ws) and (size < most or end - at < 2 * window):
            size, end = size + len(ws[end]) + 1, end + 1
        yield ws[at:end]
        if end >= len(ws):
            return
        at = end - window + 1


def _shards(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[tuple[bool, list[tuple[str, list[bytes]]]]]:
    """The items, in lists of about SHARD_CHARS characters at most, each collected on its own; True if there is one list."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null")

    def cut(batches, most=SHARD_CHARS // 4):
        for b in batches:
            out = [(i, p, b" ".join(x)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p, x in enumerate(pieces(words(t), most, window)) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["i", "piece", "w"])

    rows = rows.mapInArrow(cut, "i string, piece int, w binary")
    parts = max(1, -(-2 * rows.agg(F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()[0] // SHARD_CHARS))
    for k in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "piece", "w"), F.lit(parts)) == k)
        yield parts == 1, [(r.i, r.w.split(b" ")) for r in own.collect()]


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, finish=None) -> DataFrame:
    """``docs`` with __n_words, __hits (positions of hit words, int32) and __items (sorted ids); or, if ``finish`` is
    given, its rows made of each batch (columns of ``docs``, word counts, hits) in the same pass."""
    common.tune(spark)
    base = docs.columns
    at, ws = base.index(text_col), None
    kinds = [T.StructField("__n_words", T.LongType()), T.StructField("__hits", T.BinaryType()), T.StructField("__items", T.ArrayType(T.StringType()))]

    def one(batches, held):
        for b in batches:
            counts, hits, items = [], [], []
            for text in b.column(at).to_pylist():
                w = words(text)
                where, found = held.value.matches(w)
                counts.append(len(w))
                hits.append(where)
                items.append(sorted(found))
            yield b, counts, hits, items

    def made(b, counts, hits, items):
        if finish:
            return finish(b, counts, hits)
        new = (pa.array(counts, pa.int64()), pa.array([h.tobytes() for h in hits], pa.binary()), pa.array(items, pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays([*b.columns, *new], names=[*base, *(k.name for k in kinds)])

    for k, (lone, items) in enumerate(_shards(benchmark, item_col, item_text, window)):
        held = spark.sparkContext.broadcast(Automaton(items, window))
        if lone:

            def whole(batches, held=held):
                for found in one(batches, held):
                    yield made(*found)

            return docs.mapInArrow(common.lean(whole), docs.schema if finish else T.StructType([*docs.schema.fields, *kinds]))

        def sparse(batches, held=held):
            for b, _, hits, items in one(batches, held):
                keep = [i for i, h in enumerate(hits) if len(h)]
                texts = b.column(at).take(pa.array(keep, pa.int64())).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([key(t) for t in texts], pa.binary()), pa.array([hits[i].tobytes() for i in keep], pa.binary()), pa.array([items[i] for i in keep], pa.list_(pa.string()))], names=["__key", "__h", "__i"])

        ws = ws or common.Workspace(spark)
        hit = docs.mapInArrow(common.lean(sparse), "__key binary, __h binary, __i array<string>")
        ws.save(hit.groupBy("__key").agg(F.first("__h").alias("__h"), F.first("__i").alias("__i")), f"hits/shard={k}")
        held.unpersist()

    hits = spark.read.parquet(f"{ws.root}/hits").groupBy("__key").agg(F.collect_list("__h").alias("__h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__i")))).alias("__items"))
    found = docs.withColumn("__key", F.unhex(F.md5(F.col(text_col).cast("binary")))).join(hits, "__key", "left").select(*base, "__h", F.coalesce("__items", F.array().cast("array<string>")).alias("__items"))

    def united(batches):
        for b in batches:
            counts = [len(words(t)) for t in b.column(at).to_pylist()]
            hits = [reduce(np.union1d, [np.frombuffer(x, np.int32) for x in h or ()], np.zeros(0, np.int32)).astype(np.int32) for h in b.column(len(base)).to_pylist()]
            yield made(pa.RecordBatch.from_arrays(b.columns[: len(base)], names=base), counts, hits, b.column(len(base) + 1).to_pylist())

    return found.mapInArrow(common.lean(united), docs.schema if finish else T.StructType([*docs.schema.fields, *kinds]))


def key(text: str | None) -> bytes:
    """Digest of a text, as Spark's md5 gives it: equal texts have equal hits."""
    return hashlib.md5((text or "").encode("utf-8", "replace")).digest()


def judged(scanned: DataFrame) -> DataFrame:
    """The scan's rows with the contamination rule's verdict in __contaminated."""
    n_hit = (F.octet_length("__hits") / 4).cast("long")
    return scanned.withColumns({"__n_hit": n_hit, "__contaminated": (n_hit > 0) & (SHARE * n_hit >= F.col("__n_words"))})


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = F.coalesce("__items", F.array().cast("array<string>"))
    return judged(scanned).select(
        id_col, F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.col("__contaminated").alias("contaminated"),
    )


def without(text: str, hits: np.ndarray) -> str:
    """The text without each run of hit words (from its first word to its last, and the space that follows)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
        start, end = spans[run[0]][0], spans[run[-1]][1]
        out.append(text[at:start])
        at = end + (text[end : end + 1] in (" ", "\n"))
    return "".join([*out, text[at:]])


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """Contaminated documents go; in the others, spans that reach a window are cut out. Other rows stay as they are."""
    names = docs.columns
    at, counted = names.index(text_col), names.index(count_col) if count_col in names else None

    def finish(b, counts, hits):
        keep = [not (len(h) and SHARE * len(h) >= n) for n, h in zip(counts, hits, strict=True)]
        changed = [i for i, h in enumerate(hits) if len(h) and keep[i]]
        cols = list(b.columns)
        if changed:
            texts = b.column(at).to_pylist()
            for i in changed:
                texts[i] = without(texts[i], hits[i])
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if counted is not None:
                n = b.column(counted).to_pylist()
                for i in changed:
                    n[i] = len(texts[i])
                cols[counted] = pa.array(n, b.schema.field(counted).type)
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return scan(spark, docs, benchmark, text_col, finish=finish)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(scan(spark, docs, common.table(spark, sf_dir, "benchmark")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: decontaminated documents."""
    return clean(spark, docs, common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
h AS (SELECT p.r, p.i, s.n, array_to_string(p.w[p.i : p.i + s.n - 1], ' ') AS gram FROM p, (SELECT DISTINCT n FROM g) s WHERE p.i + s.n - 1 <= len(p.w)),
m AS (SELECT h.r, h.i, h.n, g.item FROM h JOIN g USING (n, gram)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
