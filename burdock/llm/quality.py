"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]); the bracket is the
sum-of-squares form of all pairwise interactions, so a document costs time linear in its features.

Features of a text: every distinct lower-cased word, hashed to ``WORDS`` buckets and weighted by tf / |tf|; a one-hot
bin for each structure statistic (upper case, symbols, digits, pipes, distinct words, adjacent repeats, word length,
line length) and for the length. Null and empty texts have the statistic bins of the empty text only; very long texts
are read whole. Labels, lang, source and ids are not features. Repeated rows, and ties with them, are scored one by one;
an empty table gives no rows, empty labels a score of one half; extra columns are ignored.

The model is fitted on at most ``max_train`` labelled ids (a documented bound; the ids with the smallest hash) with one
text each, so at most that many feature rows reach the driver: of an id that repeats, the text that sorts first. Ids
whose labels contradict each other, null ids and labels other than 0 and 1 teach nothing. The model's size is fixed:
(WORDS + bins) x (rank + 1) floats.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS = 1 << 16
BINS = 10
#: Upper edges of the bins of each statistic.
EDGES = {
    "upper": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95),
    "symbol": (0.005, 0.01, 0.02, 0.04, 0.07, 0.11, 0.16, 0.25, 0.4),
    "digit": (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6),
    "pipe": (0.001, 0.005, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3),
    "distinct": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "repeat": (0.001, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75, 0.9),
    "word_len": (2, 3, 4, 5, 6, 7, 8, 10, 14),
    "line_len": (20, 50, 100, 200, 300, 500, 800, 1500, 4000),
    "length": (1, 50, 200, 500, 1000, 2000, 4000, 8000, 16000),
}
SIZE = WORDS + BINS * len(EDGES)
_KINDS = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 pipe, 4 other ASCII symbol, 0 the rest
_KINDS[[*range(65, 91)]] = 1
_KINDS[[*range(48, 58)]] = 2
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = 4
_KINDS[124] = 3


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows of ``texts``: offsets, feature ids, weights. Whole texts; null counts as empty."""
    keys, stats = [], np.zeros((len(texts), len(EDGES)))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        words = raw.lower().split()
        h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=5)
        n, m = max(len(raw), 1), max(len(words), 1)
        distinct = len(np.unique(h))
        stats[i] = (kinds[1] / n, kinds[4] / n, kinds[2] / n, kinds[3] / n, distinct / m, (h[1:] == h[:-1]).sum() / m, sum(map(len, words)) / m, n / (raw.count(b"\n") + 1), len(raw))
        keys.append((h % WORDS).astype(np.int64) | np.int64(i) << 32)
    uniq, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    rows, ids = uniq >> 32, uniq & 0xFFFFFFFF
    tf = np.sqrt(tf)
    norm = np.sqrt(np.bincount(rows, tf * tf, len(texts)))
    x = tf / norm[rows] if len(rows) else tf
    bins = np.stack([np.searchsorted(edges, stats[:, j], side="left") + j * BINS + WORDS for j, edges in enumerate(EDGES.values())], 1)
    every = np.concatenate([rows, np.repeat(np.arange(len(texts)), len(EDGES))])
    order = np.argsort(every, kind="stable")
    ids = np.concatenate([ids, bins.ravel()])[order]
    x = np.concatenate([x, np.full(bins.size, 1 / np.sqrt(len(EDGES)))])[order].astype(np.float32)
    return np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(texts)))]), ids.astype(np.int32), x


def raw_score(model: dict, offsets: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    v = model["v"][ids] * x[:, None]
    starts = offsets[:-1]
    linear = np.add.reduceat(model["w"][ids] * x, starts)
    pairs = (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)).sum(1) / 2
    return model["w0"] + linear + pairs


def fit(offsets: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, rank: int = 8, epochs: int = 8, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> dict:
    """AdaGrad on the log loss, in minibatches; deterministic for given rows."""
    rng = np.random.default_rng(seed)
    model = {"w0": np.float32(0), "w": np.zeros(SIZE, np.float32), "v": (rng.standard_normal((SIZE, rank)) * 0.05).astype(np.float32)}
    if not len(y):
        return model
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model["w0"] = np.float32(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, rank), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            cut = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in part])
            lens = offsets[part + 1] - offsets[part]
            off = np.concatenate([[0], np.cumsum(lens)])
            i, xx = ids[cut], x[cut]
            row = np.repeat(np.arange(len(part)), lens)
            err = 1 / (1 + np.exp(-raw_score(model, off, i, xx))) - y[part]
            e = (err[row] * xx / len(part)).astype(np.float32)
            vx = model["v"][i] * xx[:, None]
            total = np.add.reduceat(vx, off[:-1])
            uniq, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, e, len(uniq)).astype(np.float32) + decay * model["w"][uniq]
            each = e[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(back, each[:, f], len(uniq)) for f in range(rank)], 1).astype(np.float32) + decay * model["v"][uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            model["w"][uniq] -= rate * dw / np.sqrt(gw[uniq])
            model["v"][uniq] -= rate * dv / np.sqrt(gv[uniq])
            g0 += float(err.mean()) ** 2
            model["w0"] -= np.float32(rate * err.mean() / np.sqrt(g0))
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, max_train: int = 6000) -> dict:
    """Fit on labelled ids outside the held-out fold; at most ``max_train`` of them with one text each, so the driver's share is bounded."""
    common.tune(spark)
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (common.fold("_id", folds) != held_out))
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most")).where("_y = _most").drop("_most")
        .orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def encode(batches):
        for b in batches:
            off, ids, x = features(b.column("_text").to_pylist())
            cut = range(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_y").cast(pa.int32()), pa.array([ids[off[k] : off[k + 1]].tobytes() for k in cut], pa.binary()), pa.array([x[off[k] : off[k + 1]].tobytes() for k in cut], pa.binary())],
                names=["_id", "_y", "ids", "x"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    got = rows.mapInArrow(encode, f"_id {kind}, _y int, ids binary, x binary").collect()
    got.sort(key=lambda r: (r._id, len(r.ids)))
    ids = [np.frombuffer(r.ids, np.int32) for r in got]
    return fit(
        np.concatenate([[0], np.cumsum([len(k) for k in ids])]).astype(np.int64),
        np.concatenate(ids) if ids else np.zeros(0, np.int32),
        np.concatenate([np.frombuffer(r.x, np.float32) for r in got]) if got else np.zeros(0, np.float32),
        np.array([r._y for r in got], np.float32),
    )


def score(spark: SparkSession, docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), score_col: str = "score") -> DataFrame:
    """``id_col``, columns ``keep`` and ``score_col`` (0 to 1) of each row; whole texts, one pass, no shuffle."""
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)
    cols = [id_col, *keep]
    rows = docs.select(*cols, F.col(text_col).alias("__text"))

    def run(batches):
        for b in batches:
            s = 1 / (1 + np.exp(-np.clip(raw_score(shared.value, *features(b.column(len(cols)).to_pylist())), -30, 30))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s.astype(np.float64))], names=[*cols, score_col])

    return rows.mapInArrow(common.lean(run), T.StructType([*rows.schema.fields[:-1], T.StructField(score_col, T.DoubleType())]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(spark, docs, common.table(spark, sf_dir, "labels"))
    return score(spark, docs, model).select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored under 0.3 go; the rest pass unchanged."""
    model = train(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    cols = docs.columns
    return score(spark, docs, model, keep=[c for c in cols if c != "doc_id"], score_col="__score").where("__score >= 0.3").select(*cols)
