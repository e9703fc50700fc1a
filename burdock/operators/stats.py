"""Two-group statistics, resampling and enrichment over long tables (metric, sample, grp, value).

Sums, ranks and windows are Spark expressions; only the closing p-values of the small aggregate rows and the resamplers
run in Python, group by group.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import special
from ..sources import shared
from . import ordered


def two_group(rows: DataFrame, a: str, b: str, keys: list[str], grp: str = "grp", value: str = "value") -> DataFrame:
    """n, mean, median and variance of both groups, difference (b - a), effect sizes, Welch and rank-sum statistics.

    Ranks come from one window; Cliff's delta is 2U / (n m) - 1, so no pairs are formed.
    """
    w = Window.partitionBy(*keys)
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(grp).isin(a, b))
    same = F.count("*").over(Window.partitionBy(*keys, value))
    held = held.withColumns({"__rank": F.rank().over(w.orderBy(value)) + (same - 1) / 2, "__tie": same * same - 1})  # sum of t^2 - 1 over t rows is t^3 - t
    x, y = (F.when(F.col(grp) == g, F.col(value)) for g in (a, b))
    out = held.groupBy(*keys).agg(
        F.count(x).alias("n_a"), F.count(y).alias("n_b"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.median(x).alias("median_a"), F.median(y).alias("median_b"),
        F.var_samp(x).alias("var_a"), F.var_samp(y).alias("var_b"), F.sum(F.when(F.col(grp) == b, F.col("__rank"))).alias("__r"), F.sum("__tie").cast("double").alias("ties"),
    )
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    se = va / na + vb / nb
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / F.nullif(na + nb - 2, F.lit(0)))
    delta = F.col("mean_b") - F.col("mean_a")
    u = F.col("__r") - nb * (nb + 1) / 2
    out = out.withColumns({"delta_mean": delta, "U": u})
    d = F.try_divide(F.col("delta_mean"), F.nullif(pooled, F.lit(0.0)))
    return out.withColumns({
        "cliffs_delta": 2 * F.col("U") / F.nullif(na * nb, F.lit(0)) - 1, "auc": F.col("U") / F.nullif(na * nb, F.lit(0)), "cohens_d": d, "hedges_g": d * (1 - 3 / (4 * (na + nb - 2) - 1)),
        "welch_t": F.try_divide(F.col("delta_mean"), F.sqrt(F.nullif(se, F.lit(0.0)))), "welch_df": F.try_divide(se * se, F.nullif((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1), F.lit(0.0))),
    }).drop("__r")


def with_p_values(stats: DataFrame) -> DataFrame:
    """Adds welch_p and mann_whitney_p to rows of ``two_group``."""

    @F.pandas_udf("double")
    def welch(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([special.t_two_sided(x, v) if x == x and v == v else None for x, v in zip(t, df, strict=True)], dtype="Float64")

    @F.pandas_udf("double")
    def ranks(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([special.mann_whitney(x, int(a), int(b), t) if a and b else None for x, a, b, t in zip(u, n, m, ties, strict=True)], dtype="Float64")

    return stats.withColumns({"welch_p": welch("welch_t", "welch_df"), "mann_whitney_p": ranks("U", "n_b", "n_a", "ties")})


def with_fdr(rows: DataFrame, p: str, part: list[str], tie: str, out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg step-up p within ``part``; null p stays null and does not count."""
    w = Window.partitionBy(*part, F.col(p).isNull())
    ranked = rows.withColumn("__q", F.col(p) * F.count("*").over(w) / F.row_number().over(w.orderBy(p, tie)))
    back = w.orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__q").over(back)))).drop("__q")


#: Permutations or resamples of one task.
BLOCK = 500
#: Cells of a table of permuted or drawn values that a task holds at once: 16 MB of doubles.
CELLS = 2_000_000


def _blocks(spark: SparkSession, rows: DataFrame, n: int) -> DataFrame:
    """``rows`` once for every block of ``n`` resamples, with the block's number."""
    return rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n // BLOCK) - 1).cast("long"))))


def _seeds(seed: int, head: dict, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, block, *map(ord, "|".join(str(v) for v in head.values()))])


def _runs(n: int, block: int, size: int):
    """Resamples of a block, in runs whose tables of ``size`` values a row stay under ``CELLS``."""
    left, most = min(BLOCK, n - block * BLOCK), max(1, CELLS // max(size, 1))
    while left > 0:
        yield min(most, left)
        left -= most


def _half(v: np.ndarray) -> list[np.ndarray]:
    """Sums of all subsets of ``v``, by size."""
    sums = [np.zeros(1)]
    for x in v:
        longer = [*sums, np.zeros(0)]
        sums = [np.concatenate([s, t + x]) for s, t in zip(longer, [np.zeros(0), *sums], strict=True)]
    return sums


def subsets_at_least(v: np.ndarray, k: int, bound: float) -> int:
    """Number of subsets of ``k`` of the values whose sum reaches ``bound``: the sums of one half of the values, sorted,
    are searched for what each sum of the other half lacks, so 2^(n/2) sums are held and no subset is listed."""
    left, right = _half(v[: len(v) // 2]), _half(v[len(v) // 2 :])
    found = 0
    for j in range(max(0, k - len(right) + 1), min(k, len(left) - 1) + 1):
        held = np.sort(right[k - j])
        found += int((len(held) - np.searchsorted(held, bound - left[j], "left")).sum())
    return found


_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINE = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_PLACE = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]


def _md5_heads(words: np.ndarray) -> np.ndarray:
    """First eight bytes of the MD5 of messages of one block (16 x rows of words), as big-endian integers."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x) for x in start)
    for i in range(64):
        f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        f += a
        f += words[_PLACE[i]]
        f += _SINE[i]
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURN[i])) | (f >> np.uint32(32 - _TURN[i])))
    return (a + start[0]).byteswap().astype(np.uint64) << np.uint64(32) | (b + start[1]).byteswap()


class Deals:
    """Random deals of ``k`` of the units: those whose digest with the deal's number comes first. Digests of names of up to
    40 bytes are computed for many units at once."""

    ROWS = 8192

    def __init__(self, units: list, k: int):
        self.names, self.k = [str(u).encode() for u in units], k
        self.short = all(len(u) <= 40 for u in self.names)
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _messages(self, head: int) -> np.ndarray:
        """Blocks of a message each, with room for ``head`` bytes in front of the name."""
        if self.held[0] != head:
            out = np.frombuffer(b"".join((b"\0" * head + u + b"\x80").ljust(56, b"\0") + (8 * (head + len(u))).to_bytes(8, "little") for u in self.names), np.uint8)
            self.held = head, out.reshape(-1, 64).copy()
        return self.held[1]

    def take(self, deal: int) -> np.ndarray:
        head = f"{deal}:".encode()
        if self.short and len(head) <= 15:
            m = self._messages(len(head))
            m[:, : len(head)] = np.frombuffer(head, np.uint8)
            h = np.concatenate([_md5_heads(np.ascontiguousarray(m[at : at + self.ROWS].view("<u4").T)) for at in range(0, len(m), self.ROWS)])
        else:
            h = np.array([int.from_bytes(hashlib.md5(head + u).digest()[:8], "big") for u in self.names], np.uint64)
        if self.k <= 0:
            return np.zeros(len(h), bool)
        last = np.partition(h, self.k - 1)[self.k - 1]
        out = h < last
        out[np.flatnonzero(h == last)[: self.k - out.sum()]] = True  # of equal digests the earlier units
        return out


def dealt(units: list[str], k: int, deal: int) -> np.ndarray:
    """Which ``k`` of the units a random deal picks."""
    return Deals(units, k).take(deal)


def exact_permutation(spark: SparkSession, rows: DataFrame, a: str, b: str, keys: list[str], unit: str | None = None, grp: str = "grp", value: str = "value", plus_one: bool = True, tolerance: float = 1e-15, most: int = 40, n: int = 10_000) -> DataFrame:
    """p of the difference of means (b - a) over the ways to deal out the labels, from all units of a key.

    Keys of at most ``most`` units: all ways (``exact``), counted by halves. Larger keys: ``n`` random ways, each fixed by
    its number and the units' names (without ``unit``, their places by label and value), p with one added to both counts; blocks of them are shared out over tasks. A
    difference counts as reached within ``tolerance`` (at least what sums of doubles may be off).
    """
    held = rows.where(F.col(value).isNotNull() & F.col(grp).isin(a, b)).select(*keys, (F.col(unit).cast("string") if unit else F.lit("")).alias("u"), F.col(value).cast("double").alias("v"), (F.col(grp) == b).alias("b"))
    held = held.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    kinds = dict(rows.dtypes)
    head_kind = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def start(pdf):
        pdf = pdf.sort_values(["u", "b", "v"])
        v, hot = pdf["v"].to_numpy(float), pdf["b"].to_numpy(bool)
        k = int(hot.sum())
        tol = max(tolerance, 1e-13 * len(v) * float(np.abs(v).max(initial=0)))
        return pdf.iloc[0][keys].to_dict(), (pdf["u"].tolist() if unit else list(range(len(v)))), v, hot, k, tol, (lambda s: s / k - (v.sum() - s) / (len(v) - k))

    def whole(pdf):
        head, _, v, hot, k, tol, diff = start(pdf)
        if not 0 < k < len(v):
            return pd.DataFrame(columns=[*keys, "n_permutations", "delta", "more", "two"])
        obs, slope, shift = diff(v[hot].sum()), 1 / k + 1 / (len(v) - k), v.sum() / (len(v) - k)
        reach = lambda d: subsets_at_least(v, k, (d + shift) / slope)
        total, far = math.comb(len(v), k), abs(obs) - tol
        two = total if far <= 0 else reach(far) + subsets_at_least(-v, k, -(-far + shift) / slope)
        return pd.DataFrame([head | {"n_permutations": total, "delta": obs, "more": reach(obs - tol), "two": two}])

    def some(pdf):
        block = int(pdf["__block"].iloc[0])
        head, units, v, hot, k, tol, diff = start(pdf)
        if not 0 < k < len(v):
            return pd.DataFrame(columns=[*keys, "n_permutations", "delta", "more", "two"])
        obs = diff(v[hot].sum())
        deals = Deals(units, k)
        d = np.array([diff(v[deals.take(deal)].sum()) for deal in range(block * BLOCK, min(n, (block + 1) * BLOCK))])
        return pd.DataFrame([head | {"n_permutations": len(d), "delta": obs, "more": int((d >= obs - tol).sum()), "two": int((np.abs(d) >= abs(obs) - tol).sum())}])

    shape = f"{head_kind}, n_permutations long, delta double, more long, two long"
    parts = _blocks(spark, held.where(F.col("n") > most), n).groupBy(*keys, "__block").applyInPandas(some, shape)
    drawn = parts.groupBy(*keys).agg(F.sum("n_permutations").alias("n_permutations"), F.max("delta").alias("delta"), F.sum("more").alias("more"), F.sum("two").alias("two")).withColumn("exact", F.lit(False))
    full = held.where(F.col("n") <= most).groupBy(*keys).applyInPandas(whole, shape).withColumn("exact", F.lit(True))
    add = F.when(F.col("exact"), int(plus_one)).otherwise(1)
    p = lambda c: (F.col(c) + add) / (F.col("n_permutations") + add)
    return full.unionByName(drawn).select(*keys, "n_permutations", "delta", p("more").alias("p_greater"), p("two").alias("p_two_sided"), "exact")


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks of each row of a table."""
    order = np.argsort(x, axis=1, kind="stable")
    held = np.take_along_axis(x, order, 1)
    new = np.concatenate([np.ones((len(x), 1), bool), held[:, 1:] != held[:, :-1]], 1)
    first = np.maximum.accumulate(np.where(new, np.arange(x.shape[1]), 0), 1)
    last = np.minimum.accumulate(np.where(np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], 1), np.arange(x.shape[1]), x.shape[1])[:, ::-1], 1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def _corr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def hedges(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hedges' g (y - x) of each row of two tables; NaN without spread."""
    n, m = x.shape[1], y.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        sd = np.sqrt(((n - 1) * x.var(1, ddof=1) + (m - 1) * y.var(1, ddof=1)) / (n + m - 2))
        return np.where(sd > 0, (y.mean(1) - x.mean(1)) / sd, np.nan) * (1 - 3 / (4 * (n + m - 2) - 1))


def bootstrap_effects(rows: DataFrame, a: str, b: str, keys: list[str], x: str | None = None, y: str = "value", n: int = 10_000, seed: int = 20260604, grp: str = "grp") -> DataFrame:
    """effect, observed, low, high (95 %) by key, both groups drawn anew with replacement.

    Without ``x``: hedges_g of ``y`` (2 values a group at least) and mean_b, the mean of group b. With ``x``: the
    differences (b - a) of Pearson and Spearman correlations of x and y, and the interaction, the difference of the
    slopes of y on x (3 pairs a group at least). Draws without a value are left out. Blocks of draws are shared out over
    tasks, each with a generator of its own and at most CELLS values at a time.
    """
    names = ["hedges_g", "mean_b"] if x is None else ["pearson_diff", "spearman_diff", "interaction"]
    least = 2 if x is None else 3
    cols = [y] if x is None else [x, y]

    def effects(p, q):
        if x is None:
            return [hedges(p[0], q[0]), q[0].mean(1)]
        with np.errstate(invalid="ignore", divide="ignore"):
            slope = lambda u, v: ((u - u.mean(1, keepdims=True)) * (v - v.mean(1, keepdims=True))).sum(1) / ((u - u.mean(1, keepdims=True)) ** 2).sum(1)
            return [_corr(*q) - _corr(*p), _corr(*map(_ranks, q)) - _corr(*map(_ranks, p)), slope(*q) - slope(*p)]

    def one(pdf):
        pdf = pdf.dropna(subset=cols).sort_values([grp, *cols])
        if not len(pdf):
            return pd.DataFrame(columns=[*keys, "effect", "obs", "v"])
        head, block = pdf.iloc[0][keys].to_dict(), int(pdf["__block"].iloc[0])
        p, q = ([pdf.loc[pdf[grp] == g, c].to_numpy(float)[None] for c in cols] for g in (a, b))
        if min(p[0].size, q[0].size) < least:
            return pd.DataFrame(columns=[*keys, "effect", "obs", "v"])
        rng, obs, out = _seeds(seed, head, block), effects(p, q), []
        for m in _runs(n, block, p[0].size + q[0].size):
            i, j = rng.integers(0, p[0].size, (m, p[0].size)), rng.integers(0, q[0].size, (m, q[0].size))
            out.append(np.stack(effects([c[0][i] for c in p], [c[0][j] for c in q])))
        out = np.concatenate(out, 1)
        return pd.concat([pd.DataFrame({**{k: [v] * out.shape[1] for k, v in head.items()}, "effect": e, "obs": o[0], "v": v}) for e, o, v in zip(names, obs, out, strict=True)])

    kinds = dict(rows.dtypes)
    parts = _blocks(rows.sparkSession, rows.where(F.col(grp).isin(a, b)).select(*keys, grp, *cols), n).groupBy(*keys, "__block").applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", effect string, obs double, v double")
    held = parts.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return held.groupBy(*keys, "effect").agg(F.max("obs").alias("observed"), F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))


def competitive_set(rows: DataFrame, in_set: str, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Values of a set against all others, by key (None: all rows): counts, means and their difference, U and the chance that
    a set's value is the larger, from average ranks of distinct values in sorted ranges, so no task sees a whole key."""
    keys = keys or []
    ranked = ordered.value_ranks(rows, keys, value, {"hot": F.col(in_set)})
    n, m, v = F.sum("hot"), F.sum("n") - F.sum("hot"), F.col(value)
    out = ranked.groupBy(*keys).agg(
        n.alias("n_set"), m.alias("n_background"), (F.sum(v * F.col("hot")) / F.nullif(n, F.lit(0))).alias("mean_set"), (F.sum(v * (F.col("n") - F.col("hot"))) / F.nullif(m, F.lit(0))).alias("mean_background"),
        (F.sum(F.col("hot") * F.col("rank")) - n * (n + 1) / 2).alias("U"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"),
    )
    out = out.where(F.col("n_set").isNotNull())
    return out.withColumns({"mean_difference": F.col("mean_set") - F.col("mean_background"), "auc": F.try_divide(F.col("U"), F.col("n_set") * F.col("n_background"))})


#: Values that a task of the random sets holds at most: 8 MB of doubles.
SLICE = 1_000_000


def allotted(sizes: list[int], k: int, draw: int, seed: int) -> np.ndarray:
    """How many of ``k`` values drawn without replacement fall into slices of these sizes, fixed by the draw's number."""
    return np.random.default_rng([seed, draw]).multivariate_hypergeometric(np.asarray(sizes, np.int64), k, method="marginals")


def drawn(n: int, k: int, part: int, draw: int, seed: int) -> np.ndarray:
    """Places of the ``k`` values of a slice of ``n`` that a draw takes."""
    return np.random.default_rng([seed, draw, part]).choice(n, k, replace=False, shuffle=False)


def random_sets(rows: DataFrame, in_set: str, value: str = "value", n: int = 10_000, seed: int = 20260608) -> DataFrame:
    """Adds to ``competitive_set`` of all rows the one-sided rank-sum p, and the p of the set's mean among ``n`` sets of its
    size drawn without replacement.

    Values lie in sorted ranges, cut into slices of ``SLICE``. A hypergeometric draw says how many values of each slice a
    random set takes; each slice then draws that many of its own values for every set and adds up one array of sums, and
    the arrays are summed over the slices. No task sees all values, none are copied, and the result hangs on the slices
    and the seed alone. Between tasks travel ``n`` sums a slice.
    """

    @F.pandas_udf("double")
    def ranks(u: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([special.mann_whitney(x, int(i), int(j), t, "greater") if i and j else None for x, i, j, t in zip(u, a, b, ties, strict=True)], dtype="Float64")

    spark = rows.sparkSession
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"), F.col(in_set).alias("hot"))
    held = ordered.ranges(known, ["v", "hot"]).withColumn("slice", F.floor(F.col("__at") / SLICE))
    slices = held.groupBy("__part", "slice").agg(F.count("*").alias("size"), F.count_if("hot").alias("k")).orderBy("__part", "slice").collect()  # a row for each SLICE values
    sizes, k = [r["size"] for r in slices], sum(r["k"] for r in slices)
    base = competitive_set(rows, in_set, None, value).withColumn("p_rank_sum", ranks("U", "n_set", "n_background", "ties"))
    if not k:
        return base.withColumn("p_random_sets", F.lit(None).cast("double"))
    place = spark.sparkContext.broadcast(({(r["__part"], r["slice"]): i for i, r in enumerate(slices)}, sizes))

    def one(pdf):
        places, sizes = place.value
        i = places[int(pdf["__part"].iloc[0]), int(pdf["slice"].iloc[0])]
        v = np.sort(pdf["v"].to_numpy(float))
        block = int(pdf["__block"].iloc[0])
        sums = [float(v[drawn(len(v), c, i, d, seed)].sum()) for d in range(block * BLOCK, min(n, (block + 1) * BLOCK)) for c in [int(allotted(sizes, k, d, seed)[i])]]
        return pd.DataFrame({"block": [block], "i": [i], "s": [sums]})

    def total(pdf):
        s = np.stack(pdf.sort_values("i")["s"].to_list()).sum(0)
        return pd.DataFrame({"draw": pdf["block"].iloc[0] * BLOCK + np.arange(len(s)), "mean": s / k})

    parts = _blocks(spark, held.select("__part", "slice", "v"), n).groupBy("__part", "slice", "__block").applyInPandas(one, "block long, i int, s array<double>")
    means = parts.groupBy("block").applyInPandas(total, "draw long, mean double")
    observed = base.select(F.col("mean_set").alias("o"))  # one row
    p = means.join(F.broadcast(observed)).agg(((F.count_if(F.col("mean") >= F.col("o") - 1e-12) + 1) / (F.count("*") + 1)).alias("p_random_sets"))
    return base.join(F.broadcast(p))


def correlation_difference(rows: DataFrame, x: str, y: str, a: str, b: str, keys: list[str] | None = None, grp: str = "grp") -> DataFrame:
    """Pearson and Spearman of both groups, their differences (b - a) and that of Fisher's z, by key (None: all rows)."""
    keys = keys or []
    each = rank_correlation(rows.where(F.col(grp).isin(a, b)), x, y, [*keys, grp])
    pick = lambda c, g: F.max(F.when(F.col(grp) == g, F.col(c)))
    out = each.groupBy(*keys).agg(*(pick(c, g).alias(f"{c}_{s}") for c in ("pearson", "spearman") for g, s in ((a, "a"), (b, "b"))))
    z = lambda c: F.when(F.abs(c) < 1, F.atanh(c))
    return out.withColumns({"pearson_diff": F.col("pearson_b") - F.col("pearson_a"), "spearman_diff": F.col("spearman_b") - F.col("spearman_a"), "fisher_z_diff": z(F.col("pearson_b")) - z(F.col("pearson_a"))})


def with_correlation_p(out: DataFrame) -> DataFrame:
    """Adds the two-sided p of Pearson's and Spearman's coefficients of ``rank_correlation`` (t with n - 2 degrees)."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        one = lambda c, k: None if c != c or c is None else 0.0 if abs(c) >= 1 else special.t_two_sided(c * math.sqrt((k - 2) / (1 - c * c)), k - 2)
        return pd.Series([one(c, k) for c, k in zip(r, n, strict=True)], dtype="Float64")

    return out.withColumns({"pearson_p": p("pearson", "n"), "spearman_p": p("spearman", "n")})


def resample(rows: DataFrame, a: str, b: str, keys: list[str], n: int = 10_000, seed: int = 20260604, grp: str = "grp", value: str = "value") -> DataFrame:
    """Bootstrap interval of the difference of means, and a label-permutation p, per key.

    Blocks of resamples, each with a generator of its own, are shared out over tasks; a task draws ``CELLS`` values at a time.
    """

    def one(pdf):
        pdf = pdf.sort_values([grp, value])
        head, block = pdf.iloc[0][keys].to_dict(), int(pdf["__block"].iloc[0])
        x, y = (pdf.loc[pdf[grp] == g, value].dropna().to_numpy(float) for g in (a, b))
        if not len(x) or not len(y):
            return pd.DataFrame([head | {"obs": None, "boot": None, "null": None}])
        rng, k, pool = _seeds(seed, head, block), len(y), np.concatenate([y, x])
        boot, null = [], []
        for m in _runs(n, block, len(pool)):
            boot.append(rng.choice(y, (m, k)).mean(1) - rng.choice(x, (m, len(x))).mean(1))
            mixed = rng.permuted(np.tile(pool, (m, 1)), axis=1)
            null.append(mixed[:, :k].mean(1) - mixed[:, k:].mean(1))
        boot = np.concatenate(boot)
        return pd.DataFrame({**{c: [v] * len(boot) for c, v in head.items()}, "obs": y.mean() - x.mean(), "boot": boot, "null": np.concatenate(null)})

    kinds = dict(rows.dtypes)
    parts = _blocks(rows.sparkSession, rows.select(*keys, grp, value), n).groupBy(*keys, "__block").applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", obs double, boot double, null double")
    at = lambda q: F.percentile("boot", F.lit(q))
    p = F.when(F.max("obs").isNotNull(), (F.count_if(F.abs("null") >= F.abs("obs")) + 1) / (n + 1))
    return parts.groupBy(*keys).agg(F.max("obs").alias("delta"), at(0.025).alias("low"), at(0.5).alias("median"), at(0.975).alias("high"), p.alias("p_permutation"))


def permute_within(spark: SparkSession, rows: DataFrame, bins: list[str], label: str, weight: str, sample: str, n: int = 200, seed: int = 20260606) -> DataFrame:
    """Null of the labelled weight per sample when labels are permuted inside bins: mean, sd and p of the observed sum.

    What a sample's rows get of a permuted bin is a draw without replacement from the bin's labels, so each sample draws
    from the sizes of its bins, all permutations at once (``draws_within``); its null is that of whole permutations. As with
    whole permutations, the random numbers of a permutation are the same for all samples, so only a sample's own ``n`` draws
    are independent of each other. A task holds the rows of one sample and ``n`` sums, and no permutation leaves it.
    """
    rows = rows.select(*{*bins, label, weight, sample})
    sizes = rows.groupBy(*bins).agg(F.count("*").alias("__size"), F.count_if(F.col(label)).alias("__hot"))
    named = sizes.select(*(F.col(c).alias(f"__k_{c}") for c in bins), "__size", "__hot")
    held = rows.join(named, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in bins]).drop(*(f"__k_{c}" for c in bins))

    def one(pdf):
        name = pdf[sample].iloc[0]
        pdf = pdf.sort_values([*bins, weight])
        total, obs = np.zeros(n), 0.0
        for key, part in pdf.groupby(bins, sort=True, dropna=False):
            w = part[weight].to_numpy(float)
            obs += float(w[part[label].to_numpy(bool)].sum())
            total += draws_within(w, int(part["__size"].iloc[0]), int(part["__hot"].iloc[0]), n, (seed, *map(ord, str(key))))
        near = 1e-9 * abs(obs)
        return pd.DataFrame({sample: [name], "observed": obs, "null_mean": total.mean() if n else None, "null_sd": total.std(ddof=1) if n > 1 else None, "p_greater": (int((total >= obs - near).sum()) + 1) / (n + 1)})

    kinds = dict(rows.dtypes)
    return held.groupBy(sample).applyInPandas(one, f"{sample} {kinds[sample]}, observed double, null_mean double, null_sd double, p_greater double")


#: Rows whose labels are drawn at once, by one number: a table holds the sums of all their subsets.
TOGETHER = 10
#: Draws that are held at once.
DRAWS = 4096


def _lookup(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's tables of chances ``p``: a uniform place gives itself where a uniform number is below its own share, else the other."""
    own, other = p * len(p), np.arange(len(p))
    low, high = [*np.flatnonzero(own < 1)], [*np.flatnonzero(own >= 1)]
    while low and high:
        i, j = low.pop(), high[-1]
        other[i] = j
        own[j] -= 1 - own[i]
        if own[j] < 1:
            low.append(high.pop())
    own[[*low, *high]] = 1.0
    return own, other


def _subsets(w: np.ndarray) -> np.ndarray:
    """Sums of ``w`` over all of its subsets, by their pattern of bits."""
    out = np.zeros(1 << len(w))
    for i, v in enumerate(w):
        np.add(out[: 1 << i], v, out=out[1 << i : 2 << i])
    return out


@functools.lru_cache(64)
def _labels(size: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``TOGETHER`` independent labels, each set with the chance hot / size: ``_lookup`` of their patterns."""
    n = _subsets(np.ones(TOGETHER))
    return _lookup((hot / size) ** n * (1 - hot / size) ** (TOGETHER - n))


@functools.lru_cache(1024)
def _patterns(size: int, hot: int, key: tuple, at: int, page: int) -> np.ndarray:
    """``DRAWS`` patterns of the labels of the rows from place ``at``; a worker keeps 32 MB of them at most."""
    own, other = _labels(size, hot)
    u = np.random.default_rng([*key, at, page]).random(DRAWS) * len(own)
    place = u.astype(np.intp)
    return np.where(u - place < own[place], place, other[place])


@functools.lru_cache(512)
def _set(size: int, hot: int, key: tuple, rows: int, page: int) -> np.ndarray:
    """How many of ``rows`` labels, counted in whole patterns, each draw sets."""
    n, out = _subsets(np.ones(TOGETHER)).astype(np.intp), np.zeros(DRAWS, np.intp)
    for at in range(0, rows, TOGETHER):
        out += n[_patterns(size, hot, key, at, page)]
    return out


@functools.lru_cache(1024)
def _kept(rows: int, size: int, hot: int) -> tuple[np.ndarray, float]:
    """For each number of set labels among ``rows``: its chance without replacement over its chance with it, as a share of the
    largest such ratio, and that ratio."""
    left = lambda of: np.concatenate([[0.0], np.cumsum(np.log(np.maximum(0, 1 - np.arange(rows) / of)))])
    with np.errstate(divide="ignore"):
        ratio = left(hot) + left(size - hot)[::-1] - left(size)[-1]
    return np.exp(ratio - ratio.max()), math.exp(min(700.0, ratio.max()))


def draws_within(w: np.ndarray, size: int, hot: int, n: int, key: tuple) -> np.ndarray:
    """``n`` draws of the sum of ``w`` over labelled rows, where ``hot`` of the ``size`` rows of a bin are labelled at random and
    ``w`` are some of them. ``key`` (whole numbers) fixes the random numbers.

    Labels are first drawn with replacement, for ``TOGETHER`` rows by one number. With k labels set all choices of k rows are
    alike in both cases, so a draw is kept by the ratio of the two chances of k, and kept draws are draws without replacement.
    Where ``w`` is so much of its bin that few would be kept, rows are drawn one after the other.
    """
    if hot in (0, size):
        return np.full(n, w.sum() if hot else 0.0)
    share, most = _kept(len(w), size, hot)
    if most > 4:
        rng, left, total = np.random.default_rng([*key, 0]), np.full(n, float(hot)), np.zeros(n)
        for i, v in enumerate(w):
            hit = rng.random(n) * (size - i) < left
            left -= hit
            total += v * hit
        return total
    sums = [_subsets(w[at : at + TOGETHER]) for at in range(0, len(w), TOGETHER)]
    whole = len(w) // TOGETHER * TOGETHER
    few = _subsets(np.ones(len(w) - whole)).astype(np.intp)
    out, done, page = np.empty(n), 0, 0
    while done < n:
        m, total = min(DRAWS, int((n - done) * most * 1.05) + 64), np.zeros(DRAWS)
        for i, held in enumerate(sums):
            code = _patterns(size, hot, key, i * TOGETHER, page)[:m]
            total[:m] += held.take(code if len(held) == 1 << TOGETHER else code & (len(held) - 1), mode="clip")
        k = _set(size, hot, key, whole, page)[:m]
        if whole < len(w):
            k = k + few[_patterns(size, hot, key, whole, page)[:m] & (len(few) - 1)]
        got = total[:m][np.random.default_rng([*key, 1, page, len(w)]).random(m) < share[k]][: n - done]
        out[done : done + len(got)] = got
        done, page = done + len(got), page + 1
    return out


def rank_correlation(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks) per key; null under 3 rows or 2 distinct values.

    Rows are counted by (x, y) once and the counts written; the distinct values of each column are ranked in sorted ranges
    and their ranks joined to the counts. Ranks are written too, so where a column has few values, which many pairs hold,
    Spark sees a small table and broadcasts it; with many values no key of the join is large. No task sees a whole key.
    """
    spark, at = rows.sparkSession, shared.folder(rows.sparkSession)
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    known.groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("n")).write.parquet(f"{at}/pairs")
    counts = spark.read.parquet(f"{at}/pairs")
    pairs = counts
    for c in ("__x", "__y"):
        placed = ordered.running(counts.groupBy(*keys, c).agg(F.sum("n").alias("m")), keys, c, ["m"])
        placed.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col(c).alias("__v"), (F.col("before_m") + (F.col("m") + 1) / 2).alias(f"r{c}")).write.parquet(f"{at}/ranks{c}")
        named = spark.read.parquet(f"{at}/ranks{c}")
        pairs = pairs.join(named, [F.col(c) == F.col("__v"), *(F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys)]).drop("__v", *(f"__k_{k}" for k in keys))
    rank = ((F.sum("n") + 1) / 2).alias  # the mean of average ranks
    mean = counts.groupBy(*keys).agg(*((F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"m{c}") for c in ("__x", "__y")), rank("mr__x"), rank("mr__y"))
    named = mean.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(f"m{c}" for c in ("__x", "__y", "r__x", "r__y")))
    centred = pairs.join(named, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] or F.lit(True)).drop(*(f"__k_{k}" for k in keys))

    def corr(p, q):
        u, v = F.col(p) - F.col(f"m{p}"), F.col(q) - F.col(f"m{q}")
        return F.sum(F.col("n") * u * v) / F.sqrt(F.sum(F.col("n") * u * u) * F.sum(F.col("n") * v * v))

    fit = (F.sum("n") >= 3) & (F.min("__x") < F.max("__x")) & (F.min("__y") < F.max("__y"))
    out = centred.groupBy(*keys).agg(F.sum("n").alias("n"), F.when(fit, corr("__x", "__y")).alias("pearson"), F.when(fit, corr("r__x", "r__y")).alias("spearman"))
    return out.withColumn("t", F.col("spearman") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("spearman") ** 2, F.lit(0.0))))


def ols(spark: SparkSession, rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coef, se, t, p, r2 of y on an intercept and ``xs``, from sums of products (one row reaches the driver)."""
    held = rows.select(F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), *(F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(xs))).na.drop()
    k = len(xs) + 1
    cells = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)]
    r = held.agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *cells).first()
    if r.n <= k:
        return spark.createDataFrame([], "term string, coef double, se double, t double, p double, r2 double")
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([r[f"b{i}"] for i in range(k)])
    inv = np.linalg.pinv(a)
    coef = inv @ b
    s2 = (r.yy - coef @ b) / (r.n - k)
    spread = r.yy - r.b0**2 / r.n
    r2 = float(1 - (r.yy - coef @ b) / spread) if spread > 0 else None
    se = np.sqrt(np.maximum(np.diag(inv) * s2, 0))
    t = [c / e if e > 0 else math.nan for c, e in zip(coef, se, strict=True)]
    return spark.createDataFrame([(n, float(c), float(e), float(v), float(special.t_two_sided(float(v), r.n - k)) if v == v else None, r2) for n, c, e, v in zip(["intercept", *xs], coef, se, t, strict=True)], "term string, coef double, se double, t double, p double, r2 double")


def hc3_contrast(rows: DataFrame, a: str, b: str, keys: list[str], grp: str = "grp", value: str = "value") -> DataFrame:
    """Difference of group means (a - b) with the HC3 variance, in closed form: the leverage of a row is 1 / its group's size."""
    by = rows.where(F.col(value).isNotNull() & F.col(grp).isin(a, b)).groupBy(*keys, grp).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    part = by.withColumn("var", F.col("v") * F.col("n") / F.nullif((F.col("n") - 1) * (F.col("n") - 1), F.lit(0)))
    pick = lambda c, g: F.max(F.when(F.col(grp) == g, F.col(c)))
    return part.groupBy(*keys).agg((pick("m", a) - pick("m", b)).alias("contrast"), F.sqrt(pick("var", a) + pick("var", b)).alias("se_hc3"))


def with_normal_interval(rows: DataFrame, effect: str = "contrast", se: str = "se_hc3", z: float = 1.959963984540054) -> DataFrame:
    """Adds z, two-sided normal p and the 95 % interval of an effect with a robust error."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series([None if v != v or v is None else 2 * special.normal_sf(abs(v)) for v in x], dtype="Float64")

    out = rows.withColumn("z", F.try_divide(F.col(effect), F.nullif(F.col(se), F.lit(0.0))))
    return out.withColumns({"p": p("z"), "low": F.col(effect) - z * F.col(se), "high": F.col(effect) + z * F.col(se)})


def leave_one_out(rows: DataFrame, unit: str, a: str, b: str, keys: list[str], grp: str = "grp", value: str = "value") -> DataFrame:
    """Difference of means (b - a) without each unit, from the totals less the unit's own sums; null under 2 rows a group."""
    held = rows.where(F.col(value).isNotNull() & F.col(grp).isin(a, b))
    parts = lambda g: (F.coalesce(F.sum(F.when(F.col(grp) == g, F.col(value))), F.lit(0.0)), F.count_if(F.col(grp) == g))
    cols = {f"{s}_{g}": e for g, x in (("a", a), ("b", b)) for s, e in zip(("s", "n"), parts(x), strict=True)}
    own = held.groupBy(*keys, unit).agg(*(e.alias(k) for k, e in cols.items()))
    w = Window.partitionBy(*keys)
    left = {k: F.sum(k).over(w) - F.col(k) for k in cols}
    delta = left["s_b"] / F.nullif(left["n_b"], F.lit(0)) - left["s_a"] / F.nullif(left["n_a"], F.lit(0))
    return own.select(*keys, unit, F.when((left["n_a"] >= 2) & (left["n_b"] >= 2), delta).alias("delta_without"))


def log_cpm(rows: DataFrame, sample: str = "sample", counts: str = "counts") -> DataFrame:
    return rows.withColumn("logcpm", F.log2(F.col(counts) * 1e6 / F.sum(counts).over(Window.partitionBy(sample)) + 1))


def signed_p(effect: Column, p: Column) -> Column:
    """Minus log10 of a p or an FDR with the sign of the effect; null counts as 1, 0 as the least positive double."""
    return F.signum(effect) * -F.log10(F.greatest(F.coalesce(F.nanvl(p, F.lit(None).cast("double")), F.lit(1.0)), F.lit(4.9e-324)))


def count_matrix(rows: DataFrame, samples: list[str], gene: str = "gene", sample: str = "sample", counts: str = "counts") -> DataFrame:
    """Whole counts for an outside test: one row a gene, one column a sample in the given order, 0 where there is no count;
    repeated cells are summed and rounded to whole numbers."""
    wide = rows.where(F.col(sample).isin(samples)).groupBy(gene).pivot(sample, samples).agg(F.sum(counts))
    return wide.select(gene, *(F.coalesce(F.round(F.col(f"`{s}`")).cast("long"), F.lit(0).cast("long")).alias(str(s)) for s in samples))


def design(groups: DataFrame, samples: list[str], a: str, sample: str = "sample", grp: str = "grp") -> DataFrame:
    """sample, group and place of the chosen samples, in the order of the count matrix's columns; ``a`` is the reference
    level, marked 0."""
    order = F.array_position(F.array(*map(F.lit, samples)), F.col(sample))
    return groups.where(F.col(sample).isin(samples)).select(sample, grp, (F.col(grp) != a).cast("int").alias("level"), order.alias("place"))


def risk_votes(rows: DataFrame, control: str, metrics: list[str], keys: list[str], sample: str = "sample", grp: str = "grp") -> DataFrame:
    """Votes of each sample: metrics above the largest control value of their key; the maxima are joined back, by key or,
    without keys, as one row."""
    most = rows.groupBy(*keys).agg(*(F.max(F.when(F.col(grp) == control, F.col(m))).alias(f"__{m}") for m in metrics))
    held = rows.join(most, keys, "left") if keys else rows.join(F.broadcast(most))
    votes = {f"vote_{m}": F.coalesce((F.col(m) > F.col(f"__{m}")).cast("int"), F.lit(0)) for m in metrics}
    out = held.select(*keys, sample, grp, *(e.alias(k) for k, e in votes.items()))
    total = sum((F.col(k) for k in votes), F.lit(0))
    return out.withColumns({"votes": total, "vote_fraction": total / len(votes)})


def average_sd_d(stats: DataFrame) -> DataFrame:
    """Adds cohens_d_average to rows of ``two_group``: difference (a - b) over the root of the mean of both variances."""
    sd = F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    return stats.withColumn("cohens_d_average", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.nullif(sd, F.lit(0.0))))


def de_table(rows: DataFrame, a: str, b: str, gene: str, sample: str = "sample", grp: str = "grp", counts: str = "counts", least: float = 10, least_samples: int = 3) -> DataFrame:
    """Differential expression by gene: log2 fold change (b - a) of log2(CPM + 1), Welch t and p, FDR over all tested genes.
    Tested are genes with ``least`` counts in ``least_samples`` samples; ``rows`` hold a sample's group."""
    held = log_cpm(rows, sample, counts)
    tested = held.groupBy(gene).agg(F.count_if(F.col(counts) >= least).alias("__k"), F.avg(counts).alias("mean_counts")).where(F.col("__k") >= least_samples).drop("__k")
    stats = two_group(held.withColumnRenamed("logcpm", "value"), a, b, [gene], grp)
    out = ordered.step_up(with_p_values(stats.join(tested, gene)), "welch_p")
    return out.select(gene, "mean_counts", F.col("delta_mean").alias("log2fc"), "welch_t", F.col("welch_p").alias("p"), "fdr")


def sign_test(spark: SparkSession, wins: Column, trials: Column) -> tuple[Column, Column]:
    """Upper binomial tail and Clopper-Pearson interval of aggregate counts."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([special.binomial_tail(int(a), int(b)) for a, b in zip(k, n, strict=True)])

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([special.clopper_pearson(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["low", "high"])

    return tail(wins, trials), interval(wins, trials)
