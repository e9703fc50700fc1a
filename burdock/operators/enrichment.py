"""Gene-set enrichment: label-permutation test of a running sum, and rank-based signature scores per sample."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells of a table of weights (samples x permutations) or values (genes x samples) that a task holds at once: 32 MB of doubles.
CELLS = 4_000_000
#: Samples whose labels are dealt out, at most: every task holds their names and sides.
SAMPLES = 1_000_000


def enrichment_scores(ranked: DataFrame, keys: list[str], score: str, hit: str, tie: str) -> DataFrame:
    """keys, es, n_hits, n: extreme of the running sum of weighted hits less equal steps at misses.

    The sum only turns at hits: it is highest just behind one and lowest just before one or at the end, where it is 0.
    So places are numbered by one window per key and all that follows reads the hits alone. Hits without weight count
    alike; a key without misses has null, one without hits no row.
    """
    w = Window.partitionBy(*keys)
    placed = ranked.select(*keys, F.abs(F.col(score)).alias("w"), F.col(hit).alias("hit"), F.row_number().over(w.orderBy(F.desc(score), tie)).alias("at"), F.count("*").over(w).alias("total"))
    return _walk(placed.where("hit"), keys, F.col("w")).select(*keys, "es", "n_hits", "n")


def enrichment_test(spark: SparkSession, rows: DataFrame, groups: DataFrame, members: DataFrame, a: str, b: str, n: int = 1000, seed: int = 20260608) -> DataFrame:
    """signature, es, nes, null_mean, p_greater, p_less, p_two_sided of the fold change (b - a) against permuted labels.

    ``rows``: gene, sample, value (log scale); ``groups``: sample, grp; ``members``: signature, gene. A gene's fold change
    under every permutation is a product of its values with the permutations' weights, which each task deals out anew in
    blocks of at most ``CELLS``, and each permutation is ranked as a key of its own, so no task holds more than one
    ranking. The normalised score divides by the mean of null scores of the same sign. Samples without a value count as 0.
    """
    held = groups.where(F.col("grp").isin(a, b)).select("sample", "grp").dropDuplicates(["sample"])
    if held.limit(SAMPLES + 1).count() > SAMPLES:
        raise ValueError(f"more than {SAMPLES} samples: their labels cannot be dealt out in every task")
    found = sorted((r.sample, r.grp) for r in held.collect())
    names, side = [s for s, _ in found], np.array([g == b for _, g in found])
    empty = "signature string, es double, nes double, null_mean double, n_null long, p_greater double, p_less double, p_two_sided double"
    if not side.any() or side.all():
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(({s: i for i, s in enumerate(names)}, side))

    def changes(batches):
        place, side = shared.value
        size, most = max(1, CELLS // len(side)), max(1, CELLS // len(side))
        for pdf in batches:
            for lo in range(0, len(pdf), most):
                part = pdf.iloc[lo : lo + most]
                x = np.zeros((len(part), len(side)))
                for i, (s, v) in enumerate(zip(part["s"], part["v"], strict=True)):
                    x[i, [place[k] for k in s]] = np.asarray(v, float)
                rng = np.random.default_rng(seed)
                for at in range(0, n + 1, size):
                    deals = np.stack([side if k == 0 else rng.permutation(side) for k in range(at, min(at + size, n + 1))])
                    fc = x @ np.where(deals, 1 / side.sum(), -1 / (~side).sum()).T
                    step = max(1, CELLS // len(deals))
                    for k in range(0, len(part), step):
                        yield pd.DataFrame({"gene": part["gene"].to_numpy()[k : k + step], "first": at, "fc": list(fc[k : k + step])})

    in_set = rows.join(held.select("sample"), "sample", "left_semi").where("value is not null").groupBy("gene", "sample").agg(F.sum("value").alias("value"))
    genes = in_set.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("x"))
    dealt = genes.select("gene", F.col("x.sample").alias("s"), F.col("x.value").alias("v")).mapInPandas(changes, f"gene {dict(rows.dtypes)['gene']}, first long, fc array<double>")
    fold = dealt.select("gene", "first", F.posexplode("fc").alias("k", "fc")).select("gene", (F.col("first") + F.col("k")).alias("perm"), "fc")
    sets = members.select("signature", "gene").distinct()
    # one ranking per permutation; the sets' rows alone go on from there
    w = Window.partitionBy("perm")
    ranked = fold.select("gene", "perm", "fc", F.row_number().over(w.orderBy(F.desc("fc"), "gene")).alias("at"), F.count("*").over(w).alias("total"))
    es = _walk(ranked.join(sets, "gene"), ["signature", "perm"], F.abs("fc"))
    obs = es.where("perm = 0").select("signature", F.col("es").alias("obs"))
    null = es.where("perm > 0 and es is not null").join(obs, "signature")
    same = F.when((F.col("obs") >= 0) == (F.col("es") >= 0), F.col("es"))
    p = lambda c: (F.count_if(c) + 1) / (F.count("*") + 1)
    out = null.groupBy("signature").agg(
        F.first("obs").alias("es"), (F.first("obs") / F.nullif(F.abs(F.avg(same)), F.lit(0.0))).alias("nes"), F.avg("es").alias("null_mean"), F.count("*").alias("n_null"),
        p(F.col("es") >= F.col("obs")).alias("p_greater"), p(F.col("es") <= F.col("obs")).alias("p_less"), p(F.abs("es") >= F.abs("obs")).alias("p_two_sided"),
    )
    return out.where("es is not null")


def _walk(hits: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """keys, es from the hits of each key, with their place ``at`` among ``total``."""
    w = Window.partitionBy(*keys)
    x = hits.withColumn("__w", weight.cast("double"))
    x = x.withColumns({"__t": F.sum("__w").over(w), "__h": F.count("*").over(w), "__k": F.row_number().over(w.orderBy("at")), "__s": F.sum("__w").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))})
    share = lambda s, k: F.when(F.col("__t") > 0, s / F.nullif(F.col("__t"), F.lit(0.0))).otherwise(k / F.col("__h"))
    missed = (F.col("at") - F.col("__k")) / F.nullif(F.col("total") - F.col("__h"), F.lit(0))
    up = F.greatest(F.lit(0.0), F.max(share(F.col("__s"), F.col("__k")) - missed))
    down = F.least(F.lit(0.0), F.min(share(F.col("__s") - F.col("__w"), F.col("__k") - 1) - missed))
    return x.groupBy(*keys).agg(F.when(F.max("total") > F.max("__h"), F.when(F.abs(up) >= F.abs(down), up).otherwise(down)).alias("es"), (up + down).alias("difference"), F.max("__h").alias("n_hits"), F.max("total").alias("n"))


def single_sample(rows: DataFrame, members: DataFrame, power: float = 0.25) -> DataFrame:
    """sample, signature, es, nes: single-sample enrichment (Barbie et al. 2009).

    The score is the sum, over all places of a sample's ranking, of the share of rank weight at hits so far less the
    share of misses so far. A gene at place i counts in N - i + 1 of those terms, so the sum needs the hits alone and no
    running window. ``nes``: over the range of all scores.
    """
    w = Window.partitionBy("sample")
    ranked = rows.where("value is not null").select("sample", "gene", F.row_number().over(w.orderBy(F.desc("value"), "gene")).alias("at"), F.count("*").over(w).alias("total"))
    hits = ranked.join(members.select("signature", "gene").distinct(), "gene").withColumns({"__left": F.col("total") - F.col("at") + 1})
    weight = F.pow(F.col("__left").cast("double"), F.lit(power))
    n, h = F.max("total"), F.count("*")
    miss = (n * (n + 1) / 2 - F.sum("__left")) / F.nullif(n - h, F.lit(0))
    out = hits.groupBy("sample", "signature").agg((F.sum(weight * F.col("__left")) / F.sum(weight) - miss).alias("es"), h.alias("n_genes"))
    span = out.agg((F.max("es") - F.min("es")).alias("__span"))
    return out.join(F.broadcast(span)).select("sample", "signature", "n_genes", "es", (F.col("es") / F.nullif(F.col("__span"), F.lit(0.0))).alias("nes"))


def smooth_percentiles(x: np.ndarray, terms: int = 16, reach: int = 18) -> np.ndarray:
    """Mean over j of the normal distribution function of (x_i - x_j) / h, h a quarter of the standard deviation.

    Values fall into bins of half a bandwidth. A bin's values count by their moments about its centre and act on another
    bin's centre by the derivatives of the distribution function there, which are Hermite polynomials times the density;
    bins more than ``reach`` away count as whole (the tail beyond 8.5 bandwidths is below 1e-16). The cost grows with n
    and the number of filled bins, not with pairs. An offset is at most a quarter of a bandwidth on either side, so by
    Cramer's bound the terms left out are below 0.44 (1/4)^16 / 16! sum over m of sqrt((15 + m)!) (1/4)^m / m!, under
    1e-15.
    """
    h = x.std(ddof=1) / 4
    at = (x - x.min()) / h * 2
    place = np.floor(at).astype(np.int64)
    bins, own = np.unique(place, return_inverse=True)  # filled bins alone, in order
    off = (at - place - 0.5) / 2  # in bandwidths
    power = np.cumprod(np.concatenate([np.ones((1, len(x))), off / np.arange(1, terms)[:, None]]), 0)  # off^k / k!
    moments = np.stack([np.bincount(own, p * (-1) ** k, len(bins)) for k, p in enumerate(power)], 1)
    t = np.arange(-reach, reach + 1) / 2
    slopes = [np.array([(1 + math.erf(v / math.sqrt(2))) / 2 for v in t])]
    before, he = np.zeros_like(t), np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    for k in range(2 * terms - 2):  # the (k + 1)th derivative is (-1)^k He_k times the density
        slopes.append((-1) ** k * he)
        before, he = he, t * he - k * before
    slopes = np.stack(slopes, 1)
    below = np.concatenate([[0.0], np.cumsum(moments[:, 0])])
    local = np.zeros((len(bins), terms))
    local[:, 0] = below[np.searchsorted(bins, bins - reach)]  # whole
    k, m = np.meshgrid(np.arange(terms), np.arange(terms), indexing="ij")
    for j, d in enumerate(range(-reach, reach + 1)):
        near = np.searchsorted(bins, bins - d)
        found = near < len(bins)
        found[found] = bins[near[found]] == bins[found] - d
        local[found] += moments[near[found]] @ slopes[j][k + m]
    return (local[own] * power.T).sum(1) / len(x)


def variation(rows: DataFrame, members: DataFrame) -> DataFrame:
    """sample, signature, es, n_genes: gene-set variation (Haenzelmann et al. 2013), Gaussian kernel, difference of the extremes.

    A gene's values over the samples become smoothed percentiles (bandwidth: a quarter of their standard deviation), a
    sample's genes are ranked by them, and the walk is weighted by the distance of a rank from the middle. Genes without
    spread take no part.
    """
    @F.pandas_udf("array<double>")
    def smoothed(values: pd.Series) -> pd.Series:
        return pd.Series([smooth_percentiles(np.asarray(v, float)) for v in values], dtype=object)

    by_gene = rows.where("value is not null").groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("sample", F.col("value").cast("double").alias("value")))).alias("x"), F.stddev_samp("value").alias("sd")).where("sd > 0")
    each = by_gene.select("gene", F.col("x.sample").alias("s"), smoothed("x.value").alias("p")).select("gene", F.explode(F.arrays_zip("s", "p")).alias("z")).select("gene", F.col("z.s").alias("sample"), F.round("z.p", 12).alias("p"))
    w = Window.partitionBy("sample")
    ranked = each.select("sample", "gene", F.row_number().over(w.orderBy(F.desc("p"), "gene")).alias("at"), F.count("*").over(w).alias("total"))
    weight = F.abs(F.col("total") / 2 - (F.col("total") - F.col("at") + 1))
    return _walk(ranked.join(members.select("signature", "gene").distinct(), "gene"), ["sample", "signature"], weight).select("sample", "signature", F.col("difference").alias("es"), F.col("n_hits").alias("n_genes"))
