"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks that carry int8 codes beside the originals (as floats, where the column holds floats,
else as doubles). A grid of (query group, slice of the candidate blocks) cells is joined; in a cell the int8 product of
a tile gives every inner product up to a known error (|x.y - x'.y'| <= |x'||y-y'| + |x-x'||y|). The product is summed in
slices of ``SLICE`` dimensions, whose whole numbers a float holds exactly. Only pairs whose upper bound reaches the k-th
best lower bound of their query are computed again in double precision, and the tiles' winners are merged by heaps. The
result is exact.

Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part; vectors of
different lengths are not compared. A candidate with the query's id is the query's own row. Rows that repeat an id are
candidates each; as a query the smallest vector of an id is used. Ties go to the smaller id. Without queries or without
candidates there are no rows; extra columns are ignored.

A worker holds one tile and the k best of one query group: a cell's results go out, cut into parts of ``PART`` queries,
when the next group's cell begins. A part is merged from one list of k from each slice.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK = 4096
GROUP = 8192
ROWS = 512
PART = 64
SLICE = 1024
SLICES = 4096
_BLOCK = "dim int, block long, ids binary, wide boolean, vectors binary, codes binary, stats binary"
_SIDE = ("ids", "wide", "vectors", "codes", "stats")


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v of the rows that take part; float vectors stay floats, any other numbers become doubles."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = "float" if isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType) else "double"
    return rows.select(F.col(id_col).cast("long").alias("id"), v.cast(f"array<{kind}>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes, and by vector: scale, norm, norm of the coded vector, norm of the difference."""
    d = x.astype(np.float64)
    scale = np.abs(d).max(1) / 127
    scale = np.where(scale > 0, scale, np.finfo(np.float64).tiny)
    codes = np.rint(np.clip(d / scale[:, None], -127, 127)).astype(np.int8)
    near = codes * scale[:, None]
    return codes, np.stack([scale, np.linalg.norm(d, axis=1), np.linalg.norm(near, axis=1), np.linalg.norm(d - near, axis=1)])


def _pack(size: int):
    def run(batches):
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 32

        def block(dim, ids, x):
            nonlocal made
            codes, stats = quantise(x)
            made += 1
            cells = [pa.array([ids.tobytes()], pa.binary()), pa.array([x.dtype == np.float64]), *(pa.array([a.tobytes()], pa.binary()) for a in (x, codes, stats))]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([made - 1], pa.int64()), *cells], names=["dim", "block", *_SIDE])

        for b in batches:
            ids = b.column(0).to_numpy()
            lists = b.column(1)
            dims, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            ends = np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[own], x))
                if sum(len(i) for i, _ in held[dim]) >= size:
                    i, x = (np.concatenate(z) for z in zip(*held.pop(dim), strict=True))
                    for at in range(0, len(i), size):
                        yield block(dim, i[at : at + size], x[at : at + size])
        for dim, parts in held.items():
            i, x = (np.concatenate(z) for z in zip(*parts, strict=True))
            yield block(dim, i, x)

    return run


def exact(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, in double precision, component after component."""
    out = np.zeros(len(rows))
    for at in range(0, len(rows), 100_000):
        a, b = q[rows[at : at + 100_000]].astype(np.float64), c[cols[at : at + 100_000]].astype(np.float64)
        for d in range(a.shape[1]):
            out[at : at + 100_000] += a[:, d] * b[:, d]
    return out


def _view(ids: bytes, wide: bool, vectors: bytes, codes: bytes, stats: bytes) -> tuple:
    i = np.frombuffer(ids, np.int64)
    shape = (len(i), -1)
    return i, np.frombuffer(vectors, np.float64 if wide else np.float32).reshape(shape), np.frombuffer(codes, np.int8).reshape(shape), np.frombuffer(stats, np.float64).reshape(4, -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of int8 rows, exact: 127 x 127 x SLICE is under 2^24, up to which floats hold whole numbers."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLICE):
        out += a[:, at : at + SLICE].astype(np.float32) @ b[:, at : at + SLICE].astype(np.float32).T
    return out


def tile(query: tuple, cand: tuple, best: tuple, k: int) -> None:
    """Bring ``best`` (scores and ids, k a query, best first) up to date with one tile."""
    qi, qx, qc, qs = query
    ci, cx, cc, cs = cand
    tiny = 4e-16 * (qx.shape[1] + 64)  # of |x||y|: what sums of that many doubles may be off
    for a in range(0, len(qi), ROWS):
        cut = slice(a, a + ROWS)
        with np.errstate(over="ignore", invalid="ignore"):
            near = product(qc[cut], cc) * (qs[0, cut, None] * cs[0])
            slack = qs[2, cut, None] * cs[3] + qs[3, cut, None] * cs[1] + tiny * qs[1, cut, None] * cs[1] + 1e-300
            low, high = np.nan_to_num(near - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(near + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)
        own = qi[cut, None] == ci
        low = np.where(own, -np.inf, low)
        least = best[0][cut, -1]
        if low.shape[1] >= k:
            least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
        rows, cols = np.nonzero((high >= least[:, None]) & ~own)
        if not len(rows):
            continue
        score = exact(qx[cut], cx, rows, cols)
        held = np.nonzero(best[0][cut] > -np.inf)
        rows, ids, score = np.concatenate([rows, held[0]]), np.concatenate([ci[cols], best[1][cut][held]]), np.concatenate([score, best[0][cut][held]])
        order = np.lexsort((ids, -score, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        best[0][cut][rows[keep], rank[keep]] = score[order][keep]
        best[1][cut][rows[keep], rank[keep]] = ids[order][keep]


def search(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest inner product for each query."""
    common.tune(spark)
    ws = common.Workspace(spark)
    cand = ws.save(usable(candidates, id_col, vec_col).mapInArrow(_pack(BLOCK), _BLOCK), "candidates")
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    n_queries = asked.count()
    group = ws.save(asked.repartition(max(1, -(-n_queries // GROUP)), "id").mapInArrow(_pack(GROUP), _BLOCK), "queries").withColumnRenamed("block", "g")
    slices = max(1, min(-(-cand.count() // 4), SLICES))
    left = group.select("dim", "g", *(F.col(c).alias(f"q_{c}") for c in _SIDE), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
    right = cand.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))
    # a merge join walks the left side row by row, so a group's cells of a slice follow each other
    cells = left.join(right.hint("merge"), ["dim", "s"]).select("dim", "g", *(f"q_{c}" for c in _SIDE), *_SIDE)

    def run(batches):
        at, ids, best = None, None, None

        def parts():
            cuts = range(0, len(ids), PART)
            return pa.RecordBatch.from_arrays([pa.array([at] * len(cuts), pa.int64()), pa.array([a // PART for a in cuts], pa.int32()), *(pa.array([x[a : a + PART].tobytes() for a in cuts], pa.binary()) for x in (ids, *best))], names=["g", "part", "ids", "score", "who"])

        for b in batches:
            for r in range(b.num_rows):
                row = [c[r].as_py() for c in b.columns]
                query, c = _view(*row[2:7]), _view(*row[7:12])
                if row[1] != at:
                    if at is not None:
                        yield parts()
                    n = len(query[0])
                    at, ids, best = row[1], query[0].copy(), (np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max))
                tile(query, c, best, k)
        if at is not None:
            yield parts()

    def merge(key, table):
        ids = np.frombuffer(table.column("ids")[0].as_py(), np.int64)
        lists = [(np.frombuffer(s.as_py(), np.float64).reshape(-1, k), np.frombuffer(w.as_py(), np.int64).reshape(-1, k)) for s, w in zip(table.column("score"), table.column("who"), strict=True)]
        out = []
        for q, query in enumerate(ids.tolist()):
            ranked = heapq.merge(*(zip((-s[q]).tolist(), w[q].tolist(), strict=True) for s, w in lists))
            out += [(query, rank, who, -score) for rank, (score, who) in zip(range(1, k + 1), ranked, strict=False) if score < np.inf]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "rank": pa.array(cols[1], pa.int32()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    parts = cells.mapInArrow(run, "g long, part int, ids binary, score binary, who binary")
    return parts.groupBy("g", "part").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return search(spark, rows.where("vec_id % 20 = 0"), rows)


ORACLE = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 20 = 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score FROM q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
