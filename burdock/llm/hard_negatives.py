"""Hard-negative mining by vantage-point trees.

Components become whole numbers, so scores (inner products) are exact. A row gets one more component that lifts its norm
to the largest norm of its block, an anchor gets 0: the squared distance of anchor and row is then |a|^2 + M^2 - 2 score,
nearest first is highest score first, and a window of scores is an annulus around the anchor. A block of rows is a
vantage-point tree whose nodes know the least and largest distance of each half from their vantage point. A search opens
nodes nearest first, passes over those that lie outside the annulus, and ends where the next node is farther than the
k-th best row found so far, in this block or those before it. The result is exact.

Blocks are made of near rows of few labels: labels are hashed to ``BUCKETS`` buckets, so that a search for the anchor's own
label passes over most blocks, and a tree over a sample of at most ``SAMPLE`` rows (those whose hashes come first) routes
every row to one of ``CELLS`` cells at most. Buckets and cells are cut into blocks of ``BLOCK`` rows in a sorted range of
(bucket, cell, hash), so that none of them, however many equal vectors it holds, is one task's. Groups of ``GROUP`` anchors meet slices of the blocks; a task
streams the blocks of a slice past one group. The number of slices follows the cores where groups are few.

Rows take part with an id, a label and a vector without null or non-finite components; vectors of different lengths are
not compared; zero vectors take part. A row with the anchor's id is the anchor's own row; rows that repeat an id are
candidates each, as an anchor the smallest (label, vector) of an id is used, as positives each counts. Ties go to the smaller id. Positives and
negatives that are fewer than asked for are all returned; without any there are no rows. An empty table gives no rows,
extra columns are ignored. A score must fit 64 bits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK, LEAF, GROUP = 1024, 64, 1024
SAMPLE, CELLS, BUCKETS = 2048, 64, 16
#: Of the two norms: what computed distances may be off.
SLACK = 1e-6
_INF = float("inf")


def usable(rows: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """id, label, v, h (a hash) of the rows that take part."""
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == _INF))
    return held.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad).withColumn("h", F.xxhash64("id", "v"))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows with a vector: in doubles where the sums stay under 2^53."""
    if x.size and float(np.abs(x).max()) * float(np.abs(q).max(initial=0)) * x.shape[1] >= 2**53:
        whole = lambda a: np.array([int(v) for v in a.ravel()], object).reshape(a.shape)
        return whole(x) @ whole(q)
    return x @ q


class Tree:
    """Rows of one block, in the order of the leaves, and the nodes over them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, m2: float, nodes: np.ndarray):
        self.ids, self.labels, self.x, self.m2 = ids, labels, x, m2
        self.nodes = nodes.tolist()
        self.vantage = nodes[:, 4].astype(int)
        self.points = x[np.maximum(self.vantage, 0)]

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
        sq = (x * x).sum(1)
        m2 = float(sq.max(initial=0))
        aug = np.sqrt(np.maximum(m2 - sq, 0))
        order, nodes, open_ = np.arange(len(x)), [], [(0, len(x), None, 0)]
        while open_:
            a, b, parent, side = open_.pop()
            if parent is not None:
                nodes[parent][2 + side] = len(nodes)
            nodes.append([a, b, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
            if b - a <= leaf:
                continue
            own = order[a:b]
            far = lambda i, own=own: np.sqrt(((x[own] - x[i]) ** 2).sum(1) + (aug[own] - aug[i]) ** 2)
            point = own[int(far(own[0]).argmax())]
            d = far(point)
            half = (b - a) // 2
            by = np.argpartition(d, half)  # equal distances are cut anywhere: both halves stay of one size
            order[a:b], d = own[by], d[by]
            nodes[-1][4:] = [int(point), d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max()]
            open_ += [(a + half, b, len(nodes) - 1, 1), (a, a + half, len(nodes) - 1, 0)]
        place = np.empty(len(x), int)
        place[order] = np.arange(len(x))
        nodes = np.array(nodes, np.float64).reshape(-1, 9)
        inner = nodes[:, 4] >= 0
        nodes[inner, 4] = place[nodes[inner, 4].astype(int)]
        return cls(ids[order], labels[order], x[order], m2, nodes)

    def packed(self) -> list[bytes]:
        small = np.abs(self.x).max(initial=0) <= 2**24
        return [self.ids.tobytes(), self.labels.tobytes(), self.x.astype(np.float32 if small else np.float64).tobytes(), np.array(self.nodes, np.float64).tobytes()]

    @classmethod
    def opened(cls, dim: int, ids: bytes, labels: bytes, x: bytes, nodes: bytes) -> Tree:
        i = np.frombuffer(ids, np.int64)
        kind = np.float32 if len(x) == 4 * dim * len(i) and dim else np.float64
        v = np.frombuffer(x, kind).astype(np.float64).reshape(len(i), dim)
        return cls(i, np.frombuffer(labels, np.int64), v, float((v * v).sum(1).max(initial=0)), np.frombuffer(nodes, np.float64).reshape(-1, 9))

    def distances(self, q: np.ndarray, q2: float) -> list[float]:
        """Of the anchor from every node's vantage point."""
        return np.sqrt(np.maximum(q2 + self.m2 - 2 * (self.points @ q), 0)).tolist()

    def search(self, q: np.ndarray, q2: float, far: list[float], take: np.ndarray, windows: Windows) -> None:
        """Bring the windows of one anchor up to date with the rows of this block that ``take`` marks. A node is opened if
        it may hold rows of any window, a leaf's scores are computed once for all of them."""
        whole = q2 + self.m2
        slack = SLACK * math.sqrt(whole)
        radius = lambda score: math.sqrt(max(whole - 2 * score, 0.0)) if abs(score) < _INF else (_INF if score < 0 else 0.0)
        inner, outer = radius(windows.most) - slack, radius(windows.least) + slack
        ahead = [(0.0, 0, _INF)]
        while ahead:
            near, at, farthest_of_all = heapq.heappop(ahead)
            if near > outer:
                break
            a, b, left, right, _, *shells = self.nodes[at]
            if left < 0:
                a, b = int(a), int(b)
                if windows.add(products(self.x[a:b], q), take[a:b], self.ids[a:b]):
                    outer = radius(windows.least) + slack
                continue
            d = far[at]
            for child, least, most in ((left, *shells[:2]), (right, *shells[2:])):
                nearest, farthest = max(near, d - most - slack, least - d - slack), min(farthest_of_all, d + most + slack)
                if nearest <= outer and farthest >= inner:
                    heapq.heappush(ahead, (nearest, int(child), farthest))


class Windows:
    """The score windows of one anchor, each with its ``k`` best rows so far: pairs of minus score and id, sorted."""

    def __init__(self, low: list, high: list, k: int):
        whole = max((abs(v) for v in (*low, *high) if abs(v) < _INF), default=0) >= 2**53
        self.low, self.high = (np.array(v, object if whole else float)[:, None] for v in (low, high))
        self.k, self.best = k, [[] for _ in low]
        self.open = [a <= b for a, b in zip(low, high, strict=True)]
        self.most = float(max((b for b, o in zip(high, self.open, strict=True) if o), default=-_INF))
        self._level()

    def _level(self) -> None:
        """The least score that any window still takes."""
        self.least = float(min((v for v, o in zip(self.low[:, 0], self.open, strict=True) if o), default=_INF))

    def add(self, score: np.ndarray, take: np.ndarray, ids: np.ndarray) -> bool:
        """Take over what fits; whether a window is full and its least score has gone up."""
        fit = (take & (score >= self.low) & (score <= self.high)).astype(bool)
        full = False
        for w in np.flatnonzero(fit.any(1)).tolist():
            ok = fit[w]
            best = sorted([*self.best[w], *zip((-score[ok]).tolist(), ids[ok].tolist(), strict=True)])[: self.k]
            self.best[w] = best
            if len(best) == self.k:
                self.low[w, 0], full = -best[-1][0], True
        if full:
            self._level()
        return full


def _whole(lists: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined components of vectors, scaled and rounded down."""
    return np.diff(lists.offsets.to_numpy()), np.floor(scale * lists.flatten().to_numpy().astype(np.float64))


def _router(sample: list, scale: float, cells: int) -> dict[int, list]:
    """By length of vectors, vantage points and radii that halve the sample again and again."""
    out: dict[int, list] = {}
    for dim in {len(v) for v in sample}:
        own = [v for v in sample if len(v) == dim]
        x = np.floor(scale * np.array(own, np.float64)).reshape(len(own), dim)
        m2 = float((x * x).sum(1).max(initial=0))
        x = np.hstack([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))[:, None]])
        levels, parts = [], [x]
        for _ in range(int(math.log2(cells))):
            level, halves = [], []
            for part in parts:
                point = part[int(((part - part[0]) ** 2).sum(1).argmax())] if len(part) else np.zeros(dim + 1)
                d = np.sqrt(((part - point) ** 2).sum(1))
                cut = float(np.median(d)) if len(d) else 0.0
                level.append((point, cut))
                halves += [part[d <= cut], part[d > cut]]
            levels.append(level)
            parts = halves
        out[dim] = [m2, levels]
    return out


def _cell(x: np.ndarray, router: list) -> np.ndarray:
    m2, levels = router
    x = np.hstack([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))[:, None]])
    cell = np.zeros(len(x), int)
    for level in levels:
        below = np.empty(len(x), bool)
        for c in np.unique(cell):
            own = cell == c
            point, cut = level[c]
            below[own] = np.sqrt(((x[own] - point) ** 2).sum(1)) > cut
        cell = 2 * cell + below
    return cell


def _bucket(label: str) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(BUCKETS))


def blocks(ws: common.Workspace, rows: DataFrame, scale: float) -> DataFrame:
    """Saved table of blocks: block, dim, bucket, ids, labels, x, nodes. ``rows`` as from ``usable``."""
    spark = rows.sparkSession
    cells = 1 << min(CELLS.bit_length() - 1, (rows.count() // (BLOCK * BUCKETS)).bit_length())
    router = spark.sparkContext.broadcast(_router([r.v for r in rows.orderBy("h", "id").limit(SAMPLE).select("v").collect()], scale, cells))

    def route(batches):
        for b in batches:
            dims, flat = _whole(b.column("v"), scale)
            ends, cell = np.cumsum(dims), np.zeros(len(dims), int)
            for dim in np.unique(dims).tolist():
                if dim in router.value:
                    own = np.flatnonzero(dims == dim)
                    cell[own] = _cell(flat[(ends[own] - dim)[:, None] + np.arange(dim)], router.value[dim])
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(b.column("bucket").to_numpy() * CELLS + cell, pa.int64()), *b.columns[:-1]], names=["dim", "cell", *b.schema.names[:-1]])

    def pack(batches):
        at, held, size = None, [], 0

        def block():
            ids, labels, x = (np.concatenate(z) for z in zip(*held, strict=True))
            cells_ = [pa.array([c], pa.binary()) for c in Tree.build(ids, labels, x).packed()]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1] // CELLS], pa.int64()), *cells_], names=["dim", "bucket", "ids", "labels", "x", "nodes"])

        for b in batches:
            key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            dims, flat = _whole(b.column("v"), scale)
            ends = np.cumsum(dims)
            ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else [0]
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                while a < z:
                    if at != tuple(key[a]) or size == BLOCK:
                        if size:
                            yield block()
                        at, held, size = tuple(key[a].tolist()), [], 0
                    n = min(z - a, BLOCK - size)
                    held.append((ids[a : a + n], labels[a : a + n], flat[ends[a] - dims[a] : ends[a + n - 1]].reshape(n, dims[a])))
                    size, a = size + n, a + n
        if size:
            yield block()

    routed = rows.withColumn("bucket", _bucket("label")).mapInArrow(common.lean(route), "dim int, cell long, id long, label long, v array<double>, h long")
    made = routed.repartitionByRange("dim", "cell", "h").sortWithinPartitions("dim", "cell", "h").mapInArrow(common.lean(pack), "dim int, bucket long, ids binary, labels binary, x binary, nodes binary")
    return ws.save(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _search(ws: common.Workspace, name: str, asked: DataFrame, table: DataFrame, same: bool, k: int, scale: float) -> DataFrame:
    """anchor_id, place, positive_id, positive_score, other_id, score: at most ``k`` rows for each request and slice.

    ``asked``: id, label, v, asks (list of place, positive_id, positive_score, low, high)."""
    spark = asked.sparkSession
    n_groups, n_blocks = max(1, -(-asked.count() // GROUP)), max(1, table.count())
    slices = max(1, min(-(-3 * spark.sparkContext.defaultParallelism // n_groups), n_blocks))

    def bundle(key, part):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "group": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    groups = ws.save(asked.select(F.pmod(F.xxhash64("id"), F.lit(n_groups)).alias("g"), "id", "label", _bucket("label").alias("bucket"), "v", "asks").groupBy("g").applyInArrow(bundle, "g long, group binary"), name)
    empty = F.lit(None).cast("binary")
    left = groups.select("g", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), F.lit(-1).cast("long").alias("block"), F.lit(0).alias("dim"), F.lit(0).cast("long").alias("bucket"), F.col("group").alias("ids"), *(empty.alias(c) for c in ("labels", "x", "nodes")))
    right = table.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("g"), F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("s"), "block", "dim", "bucket", "ids", "labels", "x", "nodes")
    cells = left.unionByName(right).repartition(n_groups * slices, "g", "s").sortWithinPartitions("g", "s", "block")
    names = ["anchor_id", "place", "positive_id", "positive_score", "other_id", "score"]

    def run(batches):
        group: list[tuple] = []

        def found():
            out = [(own, p["place"], p["positive_id"], p["positive_score"], i, int(-s)) for own, _, _, _, asks, windows in group for p, best in zip(asks, windows.best, strict=True) for s, i in best]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        def opened(data):
            part = pa.ipc.open_stream(data).read_all()
            for i, label, bucket, v, asks in zip(*(part.column(c).to_pylist() for c in ("id", "label", "bucket", "v", "asks")), strict=True):
                low, high = ([p[c] if p[c] is not None else far for p in asks] for c, far in (("low", -_INF), ("high", _INF)))
                yield i, label, bucket, np.floor(scale * np.array(v, np.float64)), asks, Windows(low, high, k)

        for b in batches:
            for r in range(b.num_rows):
                dim, bucket, *cols = (b.column(c)[r].as_py() for c in ("dim", "bucket", "ids", "labels", "x", "nodes"))
                if cols[1] is None:  # a group: what follows are its blocks
                    if group:
                        yield found()
                    group = list(opened(cols[0]))
                    continue
                tree = Tree.opened(dim, *cols)
                for own, label, theirs, q, _, windows in group:
                    if len(q) != dim or (same and theirs != bucket) or windows.most < windows.least:
                        continue
                    take = ((tree.labels == label) if same else (tree.labels != label)) & (tree.ids != own)
                    if take.any():
                        q2 = float(q @ q)
                        tree.search(q, q2, tree.distances(q, q2), take, windows)
        if group:
            yield found()

    return cells.mapInArrow(common.lean(run), ", ".join(f"{c} long" for c in names))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its
    ``positives`` first rows of the same label, the ``negatives`` first rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's. ``scale``: components are multiplied by it and rounded down."""
    spark = rows.sparkSession
    common.tune(spark)
    ws = common.Workspace(spark)
    held = usable(rows, id_col, label_col, vec_col)
    table = blocks(ws, held, scale)
    own = usable(anchors, id_col, label_col, vec_col).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    fields = ["place", "positive_id", "positive_score", "low", "high"]
    ask = f"array<struct<{', '.join(f'{c}: bigint' for c in fields)}>>"
    anyone = F.array(F.struct(*(F.lit(None).cast("long").alias(c) for c in fields))).cast(ask)

    like = _search(ws, "anchors", own.withColumn("asks", anyone), table, True, positives, scale)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id"))
    like = ws.save(like.withColumn("place", place.cast("long")).where(F.col("place") <= positives), "positives")
    share = lambda p: F.col("score").cast("decimal(20)") * F.lit(p).cast("decimal(9)") * F.expr("0.01BD")  # noqa: E731  a percentage, exact
    each = F.struct("place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high"))
    asks = like.groupBy("anchor_id").agg(F.collect_list(each).cast(ask).alias("asks"))
    found = _search(ws, "requests", own.join(asks, own["id"] == asks["anchor_id"]).drop("anchor_id"), table, False, negatives, scale)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
