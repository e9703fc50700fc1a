"""Language identification: script ranges narrow a word's candidate languages, hashed byte n-grams score the word in
each of them, and a Viterbi pass with a switching penalty labels the words of a (perhaps mixed) text.

A text's language is the one whose words have most letters; its score is that share. Texts without a letter, null and
empty ones get ``und`` and score 0. Ties go to the language that sorts first. Without training rows every text is
``und``; an empty document table gives no rows; very long texts are labelled whole, word by word. Repeated rows are
labelled one by one; extra columns are ignored. Any number of languages may be learned.

The model has ``SIZE`` counts a language, summed over all training texts: partial sums go through the shuffle in
chunks, and its size does not depend on the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDERS = (3, 4)
BUCKETS = 1 << 16
CHUNK = 4096
SCRIPTS = 12
SIZE = len(ORDERS) * BUCKETS + CHUNK  # the last chunk counts words by script
_SPACE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _scripts() -> np.ndarray:
    """Script of a lead byte of UTF-8: 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian and Hebrew, 5 Arabic and Syriac,
    6 Indic and other of U+0800 on, 7 Ethiopic, Georgian and others of U+1000 on, 8 symbols, 9 kana and CJK, 10 Hangul, 11 beyond."""
    out = np.zeros(256, np.int8)
    for n, (a, b) in enumerate(((0xC3, 0xCD), (0xCE, 0xCF), (0xD0, 0xD4), (0xD5, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE1), (0xE2, 0xE2), (0xE3, 0xE9), (0xEA, 0xED), (0xEE, 0xF4)), 1):
        out[a : b + 1] = n
    out[97:123] = 1
    return out


_SCRIPT = _scripts()


def split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all words, each with a space before and behind; starts of the words; number of words by text."""
    rows = [(t or "").lower().encode("utf-8", "replace").translate(_SPACE).split() for t in texts]
    counts = np.array([len(r) for r in rows], np.int64)
    raw = b" " + b" ".join(b" ".join(r) for r in rows if r) + b"    "
    buf = np.frombuffer(raw, np.uint8)
    inside = buf != 32
    return buf, np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, counts


def grams(buf: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each position, and whether it lies in one word (its own spaces included)."""
    n = len(buf) - order + 1
    h, ok = np.zeros(n, np.uint32), np.ones(n, bool)
    for k in range(order):
        part = buf[k : k + n]
        h = (h ^ part) * np.uint32(0x01000193)
        if 0 < k < order - 1:
            ok &= part != 32
    ok &= (buf[:n] != 32) | (buf[1 : n + 1] != 32)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64), ok


def word_scripts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(_SCRIPT[buf], starts) if len(starts) else np.zeros(0, np.int8)


def counts(texts: list[str]) -> np.ndarray:
    buf, starts, _ = split(texts)
    out = np.zeros(SIZE, np.int64)
    if len(starts):
        for k, order in enumerate(ORDERS):
            h, ok = grams(buf, order)
            out[k * BUCKETS : (k + 1) * BUCKETS] = np.bincount(h[ok], minlength=BUCKETS)
        out[-CHUNK : SCRIPTS - CHUNK] = np.bincount(word_scripts(buf, starts), minlength=SCRIPTS)
    return out


def _sums(batches):
    """(lang, chunk, counts) rows of this partition, summed as they come."""
    held: dict[tuple, np.ndarray] = {}
    for b in batches:
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            part = np.frombuffer(key[2], np.int64)
            held[key[:2]] = held[key[:2]] + part if key[:2] in held else part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["lang", "chunk", "n"])


#: Languages that a model learns at most (about half a MB each), and that a task holds before it passes them on.
MAX_LANGS, HELD_LANGS = 128, 16


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_langs: int = MAX_LANGS) -> dict:
    """Counts over every row of ``docs`` with a text and one of the ``max_langs`` languages that most rows have (of equal
    ones, by name): a column of many odd values makes no model that neither driver nor workers can hold."""
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    rows = rows.join(F.broadcast(known.select("lang")), "lang", "left_semi")

    def sums(held):
        for lang, n in held.items():
            chunks = [(k, c) for k, c in enumerate(n.reshape(-1, CHUNK)) if c.any()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(chunks)), pa.array([k for k, _ in chunks], pa.int32()), pa.array([c.tobytes() for _, c in chunks], pa.binary())], names=["lang", "chunk", "n"])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                held[lang] = held.get(lang, 0) + counts(texts)
                if len(held) > HELD_LANGS:
                    yield from sums(held)
                    held = {}
        yield from sums(held)

    kind = "lang string, chunk int, n binary"
    total: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, kind).repartition("lang", "chunk").mapInArrow(_sums, kind).toLocalIterator():
        total.setdefault(r.lang, np.zeros(SIZE, np.int64)).reshape(-1, CHUNK)[r.chunk] = np.frombuffer(r.n, np.int64)
    return model({k: v for k, v in total.items() if v.any()})


def model(total: dict[str, np.ndarray], alpha: float = 0.5) -> dict:
    langs = sorted(total)
    if not langs:
        return {"langs": []}
    n = np.stack([total[k] for k in langs], 1).astype(np.float64)
    logs = []
    for k in range(len(ORDERS)):
        part = n[k * BUCKETS : (k + 1) * BUCKETS] + alpha
        part = np.log(part / part.sum(0))
        logs.append((part - part.mean(1, keepdims=True)).astype(np.float32) / len(ORDERS))
    seen = n[-CHUNK : SCRIPTS - CHUNK]
    allowed = seen >= 0.01 * seen.sum(0)
    allowed[~allowed.any(1)] = True
    return {"langs": langs, "logs": logs, "barred": np.where(allowed, 0, -1e3).astype(np.float32)}


def viterbi(scores: np.ndarray, lens: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of every row of ``scores``; sequences follow each other, and all are stepped together."""
    order = np.argsort(-lens, kind="stable")
    first = (np.cumsum(lens) - lens)[order]
    size = lens[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    labels, best = np.zeros(len(scores), np.int32), np.zeros(len(scores), np.int32)
    stay = np.ones(scores.shape, bool)
    v = scores[first[: active[0]]].copy() if len(active) else None
    for t in range(1, len(active)):
        k = active[t]
        at, held = first[:k] + t, v[:k]
        top = held.max(1, keepdims=True) - penalty
        best[at], stay[at] = held.argmax(1), held >= top
        v[:k] = np.maximum(held, top) + scores[at]
    cur = v.argmax(1).astype(np.int32) if len(active) else None
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = cur[:k]
        cur[:k] = np.where(stay[at, cur[:k]], cur[:k], best[at])
    return labels


def label(m: dict, texts: list[str | None], penalty: float = 8.0) -> list[tuple[str, float, list]]:
    """(language, share of the letters, [(first word, last word, language)]) of each whole text."""
    und = ("und", 0.0, [])
    if not m["langs"]:
        return [und] * len(texts)
    buf, starts, lens = split(texts)
    if not len(starts):
        return [und if not any(map(str.isalpha, t or "")) else (m["langs"][0], 0.0, []) for t in texts]
    scores = m["barred"][word_scripts(buf, starts)].copy()
    for logs, order in zip(m["logs"], ORDERS, strict=True):
        h, ok = grams(buf, order)
        h[~ok] = 0
        for j in range(len(m["langs"])):
            scores[:, j] += np.add.reduceat(logs[h, j] * ok, starts - 1)
    labels = viterbi(scores, lens, penalty)
    weight = np.add.reduceat(((buf & 0xC0) != 0x80) & (buf != 32), starts, dtype=np.float64)
    out, at = [], 0
    for text, n in zip(texts, lens.tolist(), strict=True):
        own = labels[at : at + n]
        if not any(map(str.isalpha, text or "")):
            out.append(und)
        elif not n:
            out.append((m["langs"][0], 0.0, []))
        else:
            share = np.bincount(own, weight[at : at + n], len(m["langs"]))
            cut = np.flatnonzero(np.diff(own)) + 1
            edges = [0, *cut.tolist(), n]
            out.append((m["langs"][int(share.argmax())], float(share.max() / max(share.sum(), 1.0)), [(a, b - 1, m["langs"][own[a]]) for a, b in zip(edges, edges[1:], strict=False)]))
        at += n
    return out


def predict(docs: DataFrame, m: dict, id_col: str = "doc_id", text_col: str = "text", group_chars: int = 6 << 20) -> DataFrame:
    """id, lang_pred, score, spans (first_word, last_word, lang) of each row."""
    spark = docs.sparkSession
    common.tune(spark)
    held = spark.sparkContext.broadcast(m)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))

    def emit(ids, texts):
        got = label(held.value, texts)
        spans = pa.array([[{"first_word": a, "last_word": b, "lang": x} for a, b, x in g[2]] for g in got], span)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans], names=[id_col, "lang_pred", "score", "spans"])

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            ids.append(b.column(0))
            texts += b.column(1).to_pylist()
            size += b.column(1).nbytes
            if size > group_chars:
                yield emit(ids, texts)
                ids, texts, size = [], [], 0
        if texts:
            yield emit(ids, texts)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, spans array<struct<first_word:int,last_word:int,lang:string>>")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    m = train(docs.where(common.fold("doc_id", 4) != 2))
    return predict(docs, m).select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first_word"], s["last_word"], s["lang"])), ",").alias("spans"))
