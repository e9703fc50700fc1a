"""N-gram Jaccard join by prefix filtering under several global token orders.

A document's set: its distinct k-word shingles (fewer words: the whole sequence as one; no words: the empty set, which
links with nothing). Two sets link when |A n B| / |A u B| >= num / den. A partner shares at least need(n) =
ceil(num n / den) tokens of a set of n, so under *any* total order of the tokens two partners share one of their first
n - need(n) + 1 tokens. The join intersects that filter for three orders, before any whole set is joined:

1. rare first: tokens by the number of sets that hold them, so passages that many documents share come last. A set
   with over n - need(n) tokens of its own has a prefix nobody shares; this alone dismisses most documents
   (``profile``), before any pair is thought of.
2. and 3. by two hashes: each node carries its prefixes under these orders as 32-bit numbers beside a sketch (parity of
   its tokens in ``BITS`` cells: two sets differ by at least as many tokens as their sketches by bits, and partners
   differ by few). Pairs that fail the sketch or share no prefix token under one of the orders go here.

Equal sets are one node, however many copies there are. Pairs are not listed within a group: in
rounds, each node is verified against one leader (a node drawn from a list and size class), the one it shares most
prefix tokens with, and the verified links are contracted to components. Nodes whose lists hold several components are
then ordered anew, tokens that one component alone has first, which dismisses most of them. When few pairs are left,
when few nodes find a link, or after STARS rounds, the pairs *between* components that are left are looked for list by
list, by size classes and in cells of at most ``CELL`` x ``CELL`` nodes: a pair costs a look at two sketches there, and
only those that pass are written. The components are those of the full link graph: every pair left out lies in one
component already or has failed a filter that no link fails. A node with many pairs is dealt over several keys wherever
its set is joined.

Rows: a null id stays null and a component of null ids only has a null id; repeated rows and equal ids are fine; null
and empty texts have empty sets; very long texts are taken whole, a set must fit an Arrow batch; an empty table gives no
rows; extra columns are ignored. Ties between leaders go by hash. Tokens are 64-bit hashes of shingles, sets are told
apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FLUSH = 1_000_000
FLUSH_DOCS = 32_767
_MULTI = 0x8000
#: Rows of a table that may be broadcast (16 to 40 bytes each).
SMALL = 1_000_000
#: Rounds of verification against leaders, at most; none follows where so few pairs a node are left, or one node in
#: so many found a link.
STARS = 6
FEW = 6
RARE = 50
#: Bits of a sketch; nodes of one side of a cell of the closing join; pairs of a node that go to one key.
BITS = 512
CELL = 2048
FAN = 512
BETWEEN = "between"
#: Salts of the second and third order.
SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def need(n: Column, num: int, den: int) -> Column:
    return F.ceil(n * num / F.lit(den)).cast("int")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the whole text."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = _mix(out ^ h[j : j + len(out)]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def set_id(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which the shuffle's compression likes better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def profile(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """id, n (size of the set), fp (which set) and alive: whether need(n) of its tokens occur in another document.

    Tokens are counted by range of their hash. A task sorts the tokens of up to FLUSH; one that several of its
    documents hold is settled there and sent on once, so no token has more postings than there are flushes. Of a
    token travel its bucket and 32 further bits: two tokens taken for one can only keep a document alive.
    """
    spark = docs.sparkSession
    common.tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits = max(4, ((buckets or 4 * rows.rdd.getNumPartitions()) - 1).bit_length())

    def flush(name, ids, sets):
        lens = np.array([len(s) for s in sets], np.int64)
        tokens, own = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), lens)
        order = np.argsort(tokens)
        tokens, own = tokens[order], own[order]
        head = np.ones(len(tokens), bool)
        head[1:] = tokens[1:] != tokens[:-1]
        size = np.diff(np.append(np.flatnonzero(head), len(tokens)))
        many = np.repeat(size > 1, size)
        counts = np.bincount(own[many], minlength=len(sets)).astype(np.uint32)
        tag = own[head] | np.where(size > 1, _MULTI, 0).astype(np.uint16)
        tokens = tokens[head]
        at = np.searchsorted(tokens >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        rest = ((tokens >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        keys, blobs, tags = [name % (1 << bits)], [b""], [b""]
        for b in np.flatnonzero(np.diff(at)).tolist():
            part = rest[at[b] : at[b + 1]]
            keys.append(b)
            blobs.append(_planes(np.diff(part, prepend=np.uint32(0))))
            tags.append(_planes(tag[at[b] : at[b + 1]]))
        meta = [counts.tobytes() + lens.astype(np.uint32).tobytes() + b"".join(map(set_id, sets))]
        none = [None] * (len(keys) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([name] * len(keys), pa.int64()), pa.array(blobs, pa.binary()), pa.array(tags, pa.binary()), pa.array(meta + none, pa.binary()), pa.array([ids, *none], pa.list_(pa.int64()))],
            names=["bucket", "flush", "tokens", "tags", "meta", "ids"],
        )

    def emit(batches):
        name, ids, sets, size = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, k)
                ids.append(doc)
                sets.append(s)
                size += len(s)
                if size >= FLUSH or len(ids) >= FLUSH_DOCS:
                    yield flush(name, ids, sets)
                    name, ids, sets, size = name + 1, [], [], 0
        if ids:
            yield flush(name, ids, sets)

    def shared(key, table):
        """For each flush, the documents with a token that other flushes hold too; the flush's own row passes through."""
        flushes, tokens, tags = table.column("flush").to_numpy(), table.column("tokens").to_pylist(), table.column("tags").to_pylist()
        full = [i for i, t in enumerate(tokens) if t]
        keep = table.filter(pa.array([m is not None for m in table.column("meta").to_pylist()], pa.bool_()))
        out = keep.select(["flush", "meta", "ids"]).append_column("hits", pa.array([None] * len(keep), pa.binary()))
        if not full:
            return out
        rest = np.concatenate([np.cumsum(_unplanes(tokens[i], np.uint32), dtype=np.uint32) for i in full])
        tag = [_unplanes(tags[i], np.uint16) for i in full]
        where = np.repeat(np.arange(len(full), dtype=np.uint32), [len(t) for t in tag])
        tag = np.concatenate(tag)
        order = np.argsort(rest, kind="stable")
        rest, where, tag = rest[order], where[order], tag[order]
        same = rest[1:] == rest[:-1]
        twice = np.zeros(len(rest), bool)
        twice[1:] |= same
        twice[:-1] |= same
        pick = twice & (tag < _MULTI)
        code, n = np.unique(where[pick].astype(np.uint64) << np.uint64(16) | tag[pick], return_counts=True)
        flush_at, doc = (code >> np.uint64(16)).astype(np.int64), (code & np.uint64(0xFFFF)).astype(np.uint16)
        cuts = np.searchsorted(flush_at, np.arange(len(full) + 1))
        got = [(int(flushes[i]), doc[cuts[j] : cuts[j + 1]].tobytes() + n[cuts[j] : cuts[j + 1]].astype(np.uint32).tobytes()) for j, i in enumerate(full) if cuts[j] < cuts[j + 1]]
        del rest, where, tag, order, same, twice, pick
        common.release()
        more = pa.table([pa.array([g[0] for g in got], pa.int64()), pa.array([None] * len(got), pa.binary()), pa.array([None] * len(got), pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.binary())], names=["flush", "meta", "ids", "hits"])
        return pa.concat_tables([out, more.cast(out.schema)])

    def settle(key, table):
        meta, ids = next((m, i) for m, i in zip(table.column("meta").to_pylist(), table.column("ids").to_pylist(), strict=True) if m is not None)
        docs_n = len(ids)
        counts, lens = np.frombuffer(meta, np.uint32, docs_n).astype(np.int64), np.frombuffer(meta, np.uint32, docs_n, 4 * docs_n)
        for hits in table.column("hits").to_pylist():
            if hits:
                n = len(hits) // 6
                counts[np.frombuffer(hits, np.uint16, n)] += np.frombuffer(hits[2 * n :], np.uint32)
        fps = [meta[8 * docs_n + 16 * i : 8 * docs_n + 16 * i + 16] for i in range(docs_n)]
        alive = (counts * den >= lens.astype(np.int64) * num) & (lens > 0)
        return pa.table([pa.array(ids, pa.int64()), pa.array(lens.astype(np.int32)), pa.array(fps, pa.binary()), pa.array(alive)], names=["id", "n", "fp", "alive"])

    posted = rows.mapInArrow(common.lean(emit), "bucket int, flush long, tokens binary, tags binary, meta binary, ids array<long>")
    found = posted.groupBy("bucket").applyInArrow(shared, "flush long, meta binary, ids array<long>, hits binary")
    return found.groupBy("flush").applyInArrow(settle, "id long, n int, fp binary, alive boolean")


def prefix(tokens: np.ndarray, salt: int, num: int, den: int) -> np.ndarray:
    """The prefix of a set under the order of a hash, as 32 bits of each token's hash."""
    m = len(tokens) - -(-num * len(tokens) // den) + 1
    h = _mix(tokens ^ np.uint64(salt))
    return (h if m >= len(h) else np.partition(h, m - 1)[:m]).astype(np.uint32).view(np.int32)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of BITS cells, as 64-bit words."""
    odd = np.bincount((_mix(tokens) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def token_sets(docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """fp, n, rep, tokens, sketch, p2, p3 (prefixes under the hash orders) of each node, from the text of one document that has it."""
    wanted = common.bounded(nodes.select("rep").distinct(), SMALL)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text")

    def run(batches):
        for b in batches:
            sets = [s for t in b.column(0).to_pylist() if len(s := shingles(t, k))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), *(pa.array([prefix(s, x, num, den) for s in sets], pa.list_(pa.int32())) for x in SALTS)],
                names=["fp", "n", "tokens", "sketch", "p2", "p3"],
            )

    found = rows.mapInArrow(common.lean(run), "fp binary, n int, tokens array<long>, sketch array<long>, p2 array<int>, p3 array<int>")
    return found.join(nodes.select("fp", "rep"), "fp").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "rep", "tokens", "sketch", "p2", "p3")))


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """token, nid, n, root, own, at: the prefix of each set under the order (tokens of one root, then by number of sets).

    Tokens of one root have no partner in another, so they are counted, not listed. ``at`` is the place in the order;
    two sets whose first common token stands at a and b share at most min(n - a, n - b) tokens.
    """
    held = sets.select("nid", "n", "root", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token", "df")
    listed = held.join(counts, "token").groupBy("nid", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    listed = listed.withColumn("own", F.col("n") - F.size("t")).withColumn("room", F.col("n") - need(F.col("n"), num, den) + 1 - F.col("own")).where("room > 0")
    return listed.select("nid", "n", "root", "own", F.posexplode(F.slice("t", F.lit(1), F.col("room"))).alias("k", "t")).select(F.col("t.token").alias("token"), "nid", "n", "root", "own", (F.col("own") + F.col("k")).alias("at"))


def star(post: DataFrame, step: int, num: int, den: int) -> DataFrame:
    """(a, b): for each node of ``post`` the leader of another root it shares most listed tokens with. A list's leaders
    are one node a size class: by turns the one with fewest tokens of its own, and one drawn by a hash."""
    lists = post.select("token", "nid", "root", "own", band(F.col("n"), num, den).alias("band"))
    typical = F.col("own") if step % 2 else F.lit(0)  # an original has fewer tokens of its own than its edited copies
    lead = lists.groupBy("token", "band").agg(F.min(F.struct(typical, F.xxhash64("nid", F.lit(step)), "nid", "root")).alias("lead"), F.count("*").alias("k")).where("k > 1").select("token", "band", F.col("lead.nid").alias("lead"), F.col("lead.root").alias("lead_root"))
    votes = lists.join(lead, ["token", "band"]).where("lead_root <> root").groupBy("nid", "lead").agg(F.count("*").alias("votes"))
    return votes.groupBy("nid").agg(F.min_by("lead", F.struct(-F.col("votes"), F.xxhash64("lead", F.lit(step)), F.col("lead"))).alias("b")).select(F.col("nid").alias("a"), "b")


def band(n: Column, num: int, den: int) -> Column:
    """Size class; partners lie in one or in neighbouring ones (a class is a little wider than the ratio of partners)."""
    return F.floor(F.log(n.cast("double")) / (float(np.log(den / num)) * 1.0001))


def fits(a_n: Column, b_n: Column, a_sketch: Column, b_sketch: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes and sketches may link: partners differ by a_n + b_n - 2 x their common tokens at most."""
    both = F.ceil(num * (a_n + b_n) / F.lit(num + den))
    apart = reduce(add, (F.bit_count(F.get(a_sketch, F.lit(i)).bitwiseXOR(F.get(b_sketch, F.lit(i)))) for i in range(BITS // 64)))
    return (F.least(a_n, b_n) >= both) & (apart <= a_n + b_n - 2 * both)


def between(post: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the pairs of different roots that share a listed token and may link by place, size and sketch.

    A list's nodes meet in cells (size class, block, block): a node goes to the cells of its class and, as the larger
    partner, of the class below."""
    lists = post.withColumn("band", band(F.col("n"), num, den))
    blocks = lists.groupBy("token", "band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    w = Window.partitionBy("token").orderBy("band")
    near = lambda c, k: F.when(c(F.col("band"), 1).over(w) == F.col("band") + k, c(F.col("blocks"), 1).over(w)).otherwise(0)
    blocks = blocks.select("token", "band", "blocks", near(F.lead, 1).alias("above"), near(F.lag, -1).alias("below"))
    placed = lists.join(blocks, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    placed = placed.join(sets.select("nid", "sketch"), "nid")
    named = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("nid", "n", "root", "at", "sketch")]
    span = lambda n, cell: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), cell)).otherwise(F.array().cast("array<struct<band:bigint,up:int,i:int,j:int>>"))
    at = lambda band_, up, i, j: F.struct(band_.cast("long").alias("band"), F.lit(up).alias("up"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own, mine = F.col("block"), F.col("band")
    as_a = F.concat(span(F.col("blocks"), lambda k: at(mine, 0, own, k)), span(F.col("above"), lambda k: at(mine, 1, own, k)))
    as_b = F.concat(span(F.col("blocks"), lambda k: at(mine, 0, k, own)), span(F.col("below"), lambda k: at(mine - 1, 1, k, own)))
    left = placed.select("token", F.explode(as_a).alias("c"), *named("a")).select("*", "c.*").drop("c")
    right = placed.select("token", F.explode(as_b).alias("c"), *named("b")).select("*", "c.*").drop("c")
    key = ["token", "band", "up", "i", "j"]
    once = (F.col("up") == 1) | (F.col("a_nid") < F.col("b_nid"))  # a class meets itself in both orders
    room = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= F.ceil(num * (F.col("a_n") + F.col("b_n")) / F.lit(num + den))
    met = left.join(right, key)
    may = fits(F.col("a_n"), F.col("b_n"), F.col("a_sketch"), F.col("b_sketch"), num, den)
    return met.where(once & (F.col("a_root") != F.col("b_root")) & room & may).select(F.col("a_nid").alias("a"), F.col("b_nid").alias("b")).distinct()


def attach(rows: DataFrame, key: str, side: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``side`` for node ``key``; a node with over FAN of the ``pairs`` is dealt over several keys."""
    fan = pairs.groupBy(key).agg(F.ceil(F.count("*") / FAN).cast("int").alias("__parts"))
    left = rows.join(fan.where("__parts > 1"), key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    right = side.join(fan, key).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def verified(ws: common.Workspace, pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str, seen: list | None = None) -> DataFrame:
    """The pairs (a, b) of nodes that link. Those that fail the sketch or have no common prefix token under one of the
    hash orders go first; the whole sets are joined to the rest alone. ``seen`` gets the pairs left after each filter."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    light = lambda x: sets.select(F.col("nid").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "sketch", "p2", "p3")))
    rows = pairs.join(light("a"), "a").join(light("b"), "b")
    rows = rows.withColumn("o1", fits(F.col("a_n"), F.col("b_n"), F.col("a_sketch"), F.col("b_sketch"), num, den))
    rows = rows.withColumn("o2", F.when(F.col("o1"), F.arrays_overlap("a_p2", "b_p2")).otherwise(False))
    rows = rows.withColumn("o3", F.when(F.col("o2"), F.arrays_overlap("a_p3", "b_p3")).otherwise(False))
    watch = Observation() if seen is not None else None
    if watch:
        rows = rows.observe(watch, F.count("*").alias("pairs"), *(F.count_if(o).alias(k) for o, k in (("o1", "sketch"), ("o2", "order_2"), ("o3", "order_3"))))
    kept = ws.save(rows.where("o3").select("a", "b"), f"kept-{name}")
    if watch:
        seen.append(dict(watch.get) | {"step": name})
    whole = lambda x: sets.select(F.col("nid").alias(x), F.col("tokens").alias(f"{x}_tokens"))
    # a node has one leader at most, so ``a`` is only dealt out where ``b`` is no leader
    held = kept.join(whole("a"), "a") if name != BETWEEN else attach(kept, "a", whole("a"), kept)
    return attach(held, "b", whole("b"), kept).select("a", "b", "a_tokens", "b_tokens").mapInArrow(common.lean(run), "a long, b long")


def components(ws: common.Workspace, edges: DataFrame, name: str) -> DataFrame:
    """node, root (smallest node reachable) of every node with an edge; large-star and small-star rounds until nothing moves."""
    def put(rows: DataFrame, to: str) -> tuple[DataFrame, dict]:
        watch = Observation()
        rows = rows.observe(watch, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        return ws.save(rows, to), watch.get

    (cur, state), before, step = put(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0"), None, 0
    while True:
        if state == before or state["n"] == 0:
            return cur.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).unionByName(cur.select(F.least("a", "b").alias("node")).distinct().withColumn("root", F.col("node")))
        before, step = state, step + 1
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        cur, state = put(small, f"{name}-{step}")
        if step > 1:
            ws.drop(f"{name}-{step - 2}")


def join_components(spark: SparkSession, docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, seen: list | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n (shingles), fp (which set), component (smallest id reachable by links, itself
    included) and group (key of the component, also where it has no id). ``seen``: see ``verified``."""
    ws = common.Workspace(spark)
    info = ws.save(profile(docs, k, num, den, id_col, text_col, buckets), "info")
    nodes = ws.save(info.where("alive").groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    sets = ws.save(ws.save(token_sets(docs, nodes, k, num, den, id_col, text_col), "found").withColumn("nid", F.monotonically_increasing_id()), "sets")
    ws.drop("found")

    # order 1: rare tokens first; tokens of one set only come before all and are counted, not listed
    post = ws.save(prefixes(sets.withColumn("root", F.col("nid")), num, den), "prefixes-0")
    roots, left = None, ["prefixes-0"]
    for step in range(1, STARS + 1):
        # each node against the leader, of another component, that it shares most prefix tokens with
        links = ws.save(verified(ws, star(post, step, num, den), sets, num, den, str(step), seen), f"links-{step}")
        before = links if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
        roots = ws.save(components(ws, before, f"star-{step}"), f"roots-{step}")
        # the nodes of lists that hold several components are ordered anew, tokens of one component first
        rooted = post.drop("root").join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("token", "nid", F.coalesce("root", "nid").alias("root"))
        mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
        open_ = ws.save(rooted.join(mixed, "token").select("nid", "root").distinct(), f"open-{step}")
        post = ws.save(prefixes(sets.drop("sketch", "p2", "p3").join(open_, "nid"), num, den), f"prefixes-{step}")
        n = post.groupBy("token").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0))).first()[0]
        ended = n <= FEW * open_.count() or RARE * links.count() <= open_.count()
        ws.drop(*left, f"kept-{step}", f"open-{step}")
        left = [f"links-{step}", f"roots-{step}", f"prefixes-{step}"]
        if ended:
            break

    more = verified(ws, between(post, sets, num, den), sets, num, den, BETWEEN, seen)
    roots = ws.save(components(ws, ws.save(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "edges"), "all"), "roots")

    named = sets.select("nid", "fp", "rep").join(roots, F.col("nid") == F.col("node")).select("fp", "root", "rep")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    by_set = nodes.join(named.join(smallest, "root").select("fp", "root", "component"), "fp", "left").select("fp", F.coalesce("component", "rep").alias("component"), "root")
    by_set = ws.save(by_set, "components")
    ws.drop(*left, "nodes", "sets", "edges", "roots", f"kept-{BETWEEN}")
    out = info.join(common.bounded(by_set, SMALL), "fp", "left")
    group = F.coalesce(F.concat(F.lit("r"), F.col("root").cast("string")), F.hex("fp"))
    return out.select("id", "n", "fp", F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id")).alias("component"), group.alias("group"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = join_components(spark, common.table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, hash(g) AS h, g FROM (SELECT r, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
t AS (SELECT r, r AS o FROM d UNION SELECT t.r, e.y FROM t JOIN e ON t.o = e.x),
c AS (SELECT t.r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.o GROUP BY t.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN c USING (r)
"""


def _with_set(docs: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """``docs`` with __fp and __n of each row's set."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            sets = [shingles(t, k) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())], names=[*b.schema.names, "__fp", "__n"])

    return docs.mapInArrow(common.lean(run), T.StructType([*docs.schema.fields, T.StructField("__fp", T.BinaryType()), T.StructField("__n", T.IntegerType())]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Pipeline stage: of each group one document stays, the one with the smallest id; documents without words stay.

    Rows that share an id, or have none, are told apart by their sets: of a group's rows with its smallest id (of its
    rows, if none has one) those with the first set are taken, and of these one row."""
    got = common.Workspace(spark).save(join_components(spark, docs, k, num, den), "groups")
    shared = got.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("doc_id"))
    gone = got.where("n > 0 and id is not null and id <> component").select(F.col("id").alias("doc_id"))
    if shared.limit(1).count() == 0:
        return docs.join(common.bounded(gone, SMALL), "doc_id", "left_anti")
    shared = common.bounded(shared.where("doc_id is not null"), SMALL)
    plain = docs.where("doc_id is not null").join(shared, "doc_id", "left_anti").join(common.bounded(gone.distinct(), SMALL), "doc_id", "left_anti")
    odd = docs.where("doc_id is null").unionByName(docs.join(shared, "doc_id", "left_semi").select(*docs.columns))
    odd = _with_set(odd, k)
    first = got.where("n > 0 and id <=> component").groupBy("group").agg(F.first("id").alias("__id"), F.min("fp").alias("__first"))
    one = odd.where("__n > 0").join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__first")), "left_semi").dropDuplicates(["doc_id", "__fp"])
    return plain.unionByName(odd.where("__n = 0").unionByName(one).drop("__fp", "__n"))
