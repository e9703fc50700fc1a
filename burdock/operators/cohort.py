"""Cohort analytics over long tables: merging of predictions, collapse, burden, concentration, ranks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..schema import CLASS_ORDER
from . import ordered


def merge_predictions(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Full outer join of predictor tables (key, prob, pred) by id; missing labels are NA; the consensus of all labels."""
    named = [t.select(key, F.col("prob").alias(f"{n}_prob"), F.col("pred").alias(f"{n}_pred")) for n, t in tables.items()]
    wide = reduce(lambda a, b: a.join(b, key, "full_outer"), named)
    wide = wide.withColumns({f"{n}_pred": labels.normal(F.col(f"{n}_pred")) for n in tables})
    return wide.withColumn("consensus", labels.consensus(*(F.col(f"{n}_pred") for n in tables)))


def collapse(rows: DataFrame, keys: list[str], means: list[str], maxima: list[str], label: str, protein: str) -> DataFrame:
    """One row per key: maxima, means, number of proteins, the label that comes first in the order of precedence."""
    return rows.groupBy(*keys).agg(*(F.max(c).alias(f"{c}_max") for c in maxima), *(F.avg(c).alias(f"{c}_mean") for c in means), F.countDistinct(protein).alias("n_proteins"), labels.first_of(F.col(label)).alias(label))


def tpm(rows: DataFrame, sample: str = "sample", value: str = "counts") -> DataFrame:
    return rows.withColumn("tpm", F.col(value) * 1e6 / F.sum(value).over(Window.partitionBy(sample)))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, F.nullif(whole, F.lit(0.0)))


def sample_burden(rows: DataFrame, sample: str = "sample", least: float = 0.5) -> DataFrame:
    """Sums and guarded ratios of expression by sample. ``rows``: tpm, score (null: not annotated), positive."""
    t, known = F.col("tpm"), F.col("score").isNotNull()
    out = rows.groupBy(sample).agg(
        F.sum(t).alias("total_TPM"), F.coalesce(F.sum(F.when(known, t)), F.lit(0.0)).alias("annotated_TPM"), F.coalesce(F.sum(F.when(F.col("positive"), t)), F.lit(0.0)).alias("strict_TPM"),
        F.coalesce(F.sum(F.col("score") * t), F.lit(0.0)).alias("weighted_sum"), F.count_if(F.col("positive") & (t >= 1)).alias("n_strict_expressed"), F.count_if(known & (t >= 1)).alias("n_annotated_expressed"),
    )
    out = out.withColumns({"annotation_fraction": share(F.col("annotated_TPM"), F.col("total_TPM")), "strict_fraction": share(F.col("strict_TPM"), F.col("annotated_TPM")), "weighted_index": share(F.col("weighted_sum"), F.col("annotated_TPM"))})
    return out.withColumn("keep_coverage", F.col("annotation_fraction") >= least)


def class_burden(rows: DataFrame, classes: list[str], sample: str = "sample", hydropathy: str | None = None) -> DataFrame:
    """Per sample, predictor and class: sum of log2(TPM + 1), its share of the sample and the number of rows; absent
    combinations are 0. With ``hydropathy``: also the share of the sums weighted by it, hydropathy_share."""
    kd = F.col(hydropathy).cast("double") if hydropathy else F.lit(None).cast("double")
    w = F.log2(F.col("tpm") + 1)
    long = rows.select(sample, w.alias("w"), (w * kd).alias("k"), *classes).unpivot([sample, "w", "k"], classes, "predictor", "class")
    sums = long.where("class is not null").groupBy(sample, "predictor", "class").agg(F.sum("w").alias("burden"), F.sum("k").alias("weighted"), F.count("*").alias("n"))
    cells = F.explode(F.array(*(F.struct(F.lit(p).alias("predictor"), F.lit(c).alias("class")) for p in classes for c in CLASS_ORDER)))
    grid = rows.groupBy(sample).agg(F.sum(w).alias("whole"), F.sum(w * kd).alias("whole_k")).select(sample, "whole", "whole_k", cells.alias("x")).select(sample, "whole", "whole_k", "x.*")
    full = grid.join(sums, [sample, "predictor", "class"], "left")
    more = [F.coalesce(share(F.col("weighted"), F.col("whole_k")), F.lit(0.0)).alias("hydropathy_share")] if hydropathy else []
    return full.select(sample, "predictor", "class", F.coalesce("burden", F.lit(0.0)).alias("burden"), F.coalesce(share(F.col("burden"), F.col("whole")), F.lit(0.0)).alias("share"), F.coalesce("n", F.lit(0)).alias("n"), *more)


def tails(rows: DataFrame, value: str, sample: str = "sample", top: float = 0.01) -> DataFrame:
    """q90, q95 and the sum of the top share (at least one row) of each sample."""
    w = Window.partitionBy(sample)
    ranked = rows.where(F.col(value).isNotNull()).withColumns({"rn": F.row_number().over(w.orderBy(F.desc(value))), "n": F.count("*").over(w)})
    return ranked.groupBy(sample).agg(F.percentile(value, F.lit(0.9)).alias("q90"), F.percentile(value, F.lit(0.95)).alias("q95"), F.sum(F.when(F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n") * top)), F.col(value))).alias("top_mass"))


def concentration(rows: DataFrame, value: str, sample: str = "sample", tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Gini coefficient and top-N shares of the positive values of each sample."""
    w = Window.partitionBy(sample)
    ranked = rows.where(F.col(value) > 0).withColumns({"up": F.row_number().over(w.orderBy(value)), "down": F.row_number().over(w.orderBy(F.desc(value)))})
    x, n, total = F.col(value), F.count("*"), F.sum(value)
    gini = F.when(n == 1, 0.0).otherwise(2 * F.sum(F.col("up") * x) / (n * total) - (n + 1) / n)
    return ranked.groupBy(sample).agg(gini.alias("gini"), *(F.coalesce(F.sum(F.when(F.col("down") <= k, x)) / total, F.lit(0.0)).alias(f"top{k}_share") for k in tops))


def top_rows(rows: DataFrame, by: str, group: str, n: int, tie: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), tie))).where(F.col("rank") <= n)


def rank_percentile(value: str, part: str) -> Column:
    """(average rank - 1) / (n - 1) within ``part``."""
    w = Window.partitionBy(part)
    ties = F.count("*").over(Window.partitionBy(part, value))
    return (F.rank().over(w.orderBy(value)) + (ties - 1) / 2 - 1) / F.nullif(F.count("*").over(w) - 1, F.lit(0))


def quantile_bin(value: str, part: str, tie: str, bins: int = 5) -> Column:
    """Equal-frequency bin of the first-come rank, edges interpolated between ranks."""
    w = Window.partitionBy(part)
    n = F.count("*").over(w)
    r = F.row_number().over(w.orderBy(value, tie))
    return F.when(n == 1, 0).otherwise(F.greatest(F.lit(0), F.ceil((r - 1) * bins / (n - 1)).cast("int") - 1))


def z_scores(rows: DataFrame, cols: list[str]) -> DataFrame:
    """z_<col> over all rows (population sd, null where it is 0): one aggregate row is joined back, no global window."""
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols))
    return rows.join(F.broadcast(stats)).withColumns({f"z_{c}": (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)) for c in cols}).drop(*stats.columns)


def integrative_index(rows: DataFrame) -> DataFrame:
    """Mean of the z-scores of sheet propensity, largest hydropathy and aromaticity less those of the distance of the
    charge density from 0 and of the isoelectric point from 7, over all rows; the z columns stay."""
    odd = rows.withColumns({"abs_charge_density": F.abs("charge_density"), "pI_distance": F.abs(F.col("pI") - 7)})
    plus, minus = ["beta_propensity", "KD_max", "aromaticity"], ["abs_charge_density", "pI_distance"]
    out = z_scores(odd, plus + minus)
    return out.withColumn("integrative_index", (sum(F.col(f"z_{c}") for c in plus) - sum(F.col(f"z_{c}") for c in minus)) / 5)


def describe(rows: DataFrame, value: str, keys: list[str], percents: tuple[int, ...] = (1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """n, mean, sd, least, percentiles and largest value by key; percentiles come from sorted ranges, so a key may be large."""
    cuts = ordered.quantiles(rows, keys, value, {f"p{k:02d}": k / 100 for k in percents})
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.join(cuts, keys, "left").select(*keys, "n", "mean", "sd", "min", *(f"p{k:02d}" for k in percents), "max")


def stacked_counts(rows: DataFrame, predictors: list[str], keys: list[str]) -> DataFrame:
    """Rows by predictor, key and prediction."""
    return rows.unpivot(keys, predictors, "predictor", "prediction").groupBy("predictor", *keys, "prediction").agg(F.count("*").alias("n"))


def burden_metrics(rows: DataFrame, sample: str = "sample") -> DataFrame:
    """Burden of the positive rows by TPM, by log2(TPM + 1) and by that times the largest hydropathy, and the mean score
    weighted by TPM. ``rows``: tpm, score, positive, kd_max."""
    w = F.log2(F.col("tpm") + 1)
    hot = lambda e: F.sum(F.when(F.col("positive"), e))
    known = F.sum(F.when(F.col("score").isNotNull(), F.col("tpm")))
    return rows.groupBy(sample).agg(hot(F.col("tpm")).alias("tpm_burden"), hot(w).alias("log2_burden"), hot(w * F.col("kd_max")).alias("hydropathy_burden"), share(F.sum(F.col("tpm") * F.col("score")), known).alias("weighted_score"))


def panel_rollup(rows: DataFrame, gene: str, value: str, least: float = 1.0, sample: str = "sample") -> DataFrame:
    """Sums by sample and gene, rolled up by sample."""
    by = rows.groupBy(sample, gene).agg(F.sum(value).alias("g"))
    return by.groupBy(sample).agg(F.count("*").alias("n_genes"), F.count_if(F.col("g") > least).alias("n_expressed"), F.sum("g").alias("total"), F.avg("g").alias("mean"), F.max("g").alias("most"))


def signature_coverage(members: DataFrame, found: DataFrame) -> DataFrame:
    """Genes of each signature that are among ``found`` (gene), and those that are not, as sorted lists."""
    both = members.distinct().join(found.select("gene", F.lit(True).alias("on")).distinct(), "gene", "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("gene")))), ",")
    return both.groupBy("signature").agg(F.count("*").alias("n_genes"), F.count("on").alias("n_present"), names(F.col("on")).alias("present"), names(F.col("on").isNull()).alias("missing"))


def pair_summary(pairs: DataFrame, samples: DataFrame, sample: str = "sample") -> DataFrame:
    """Matched pairs of every sample: number, shifts, share of pairs above 0 and distances; samples without pairs have 0.
    ``pairs``: shift, distance."""
    own = pairs.groupBy(sample).agg(
        F.count("shift").alias("n_pairs"), F.avg("shift").alias("mean_shift"), F.median("shift").alias("median_shift"),
        F.avg((F.col("shift") > 0).cast("int")).alias("fraction_up"), F.avg("distance").alias("mean_distance"), F.median("distance").alias("median_distance"),
    )
    return samples.join(own, sample, "left").na.fill(0, ["n_pairs"])


def stability(rows: DataFrame, keys: list[str], flag: str, value: str) -> DataFrame:
    """Rows, rows with the flag, and least, median and largest value by key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_true"), F.min(value).alias("min"), F.median(value).alias("median"), F.max(value).alias("max"))


def first_known(value: str, order: str) -> Column:
    """Aggregate: the first value, in ``order``, that is not null."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def by_list(col: str, order: list[str]) -> Column:
    """Place of a category in a given order; others last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(col)), F.lit(0)), F.lit(len(order) + 1))


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows with their place in a total order, from 1: ranges are sorted, each task numbers its own, and the ranges' sizes
    (one row a partition) are summed up, so no task sees all rows."""
    held = ordered.ranges(rows, order)
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return held.join(F.broadcast(starts), "__part").withColumn(out, F.col("__at") + F.col("__before") + 1).drop("__part", "__at", "__before")


def matrix_slice(table: DataFrame, samples: list[str] | None = None, ids: list[str] | None = None, sample: str = "sample", id_col: str = "id") -> DataFrame:
    """Cells of chosen samples and ids of a long matrix; on a store by sample both choices reach the scan."""
    for col, wanted in ((sample, samples), (id_col, ids)):
        table = table if wanted is None else table.where(F.col(col).isin(list(wanted)))
    return table


def dense(table: DataFrame, axis: list[str], sample: str = "sample", id_col: str = "id", value: str = "value", order: str = "ord") -> DataFrame:
    """One row per id and one column per sample of ``axis``; of repeated cells the last, null where there is none."""
    last = table.where(F.col(sample).isin(axis)).groupBy(id_col, sample).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(id_col).pivot(sample, axis).agg(F.first("v"))


def signature_scores(rows: DataFrame, members: DataFrame, sample: str = "sample", gene: str = "gene", value: str = "tpm") -> DataFrame:
    """Mean of the genes' z-scores across samples, and mean rank percentile within the sample, of each gene set."""
    z = Window.partitionBy(gene)
    scored = rows.withColumns({"z": (F.col(value) - F.avg(value).over(z)) / F.nullif(F.stddev_pop(value).over(z), F.lit(0.0)), "pct": rank_percentile(value, sample)})
    return scored.join(members, gene).groupBy(sample, "signature").agg(F.avg("z").alias("mean_z"), F.avg("pct").alias("rank_score"), F.count("*").alias("n_genes"))


class Free:
    """Controls that are still free, in the order of their first feature, so that a search looks outwards from a point and
    ends where the first feature alone is farther than what it has found."""

    def __init__(self, x: np.ndarray, rank: np.ndarray):
        self.order = np.argsort(x[:, 0], kind="stable")
        self.x, self.rank = x[self.order], rank[self.order]
        self.free = np.ones(len(x), bool)
        self.at = np.empty(len(x), int)
        self.at[self.order] = np.arange(len(x))
        self.left = len(x)

    def take(self, i: int) -> None:
        self.free[self.at[i]] = False
        self.left -= 1

    def nearest(self, q: np.ndarray, penalty, best: tuple[float, float, int], least: float = 0.0) -> tuple[float, float, int]:
        """(distance, rank, control): the better of ``best`` and the nearest free control; ``penalty(places)`` is added to
        the distance, ``least`` is the least it adds. Of equal distances the smaller rank counts."""
        low = high = int(np.searchsorted(self.x[:, 0], q[0]))
        step, n = 32, len(self.x)
        while True:
            reach, done = (best[0] - least) * (1 + 1e-12) + 1e-12, True
            for right in (True, False):
                if right and high < n and self.x[high, 0] - q[0] <= reach:
                    a, b = high, min(n, high + step)
                    high = b
                elif not right and low > 0 and q[0] - self.x[low - 1, 0] <= reach:
                    a, b = max(0, low - step), low
                    low = a
                else:
                    continue
                done = False
                at = a + np.flatnonzero(self.free[a:b])
                if len(at):
                    d = np.sqrt(((self.x[at] - q) ** 2).sum(1))
                    d = penalty(d, self.order[at])
                    first = np.lexsort((self.rank[at], d))[0]
                    best = min(best, (float(d[first]), float(self.rank[at[first]]), int(self.order[at[first]])))
            if done:
                return best
            step *= 2


#: Cells of a table of distances, and controls of a part, up to which distances are taken from such tables.
CELLS, NEAR = 1 << 18, 1 << 12


def _from_tables(x: np.ndarray, own: np.ndarray, mine: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the control, distance) of each treated row in turn, from tables of the distances of some treated rows to all
    controls. A column of ``held`` (codes, -1: none) counts while a free control has a value there."""
    n = min(len(x), len(own))
    has, known = (held >= 0).tolist(), (held >= 0).sum(0).tolist()
    taken, row, found, far = np.zeros(len(own)), np.empty(len(own)), np.empty(n, int), np.empty(n)
    k, end, counted = 0, 0, []
    while k < n:
        if k == end or counted != [c for c, v in enumerate(known) if v]:
            start, end, counted = k, min(n, k + max(CELLS // len(own), 1)), [c for c, v in enumerate(known) if v]
            d = np.zeros((end - start, len(own)))
            for f in range(x.shape[1]):
                d += (own[None, :, f] - x[start:end, None, f]) ** 2
            np.sqrt(d, out=d)
            for c in counted:
                d += 2.0 * ((held[None, :, c] != mine[start:end, None, c]) & (mine[start:end, None, c] >= 0))
        np.add(d[k - start], taken, out=row)
        i = int(row.argmin())
        found[k], far[k], taken[i] = i, row[i], np.inf
        for c, v in enumerate(has[i]):
            known[c] -= v
        k += 1
    return found, far


def _by_search(x: np.ndarray, own: np.ndarray, mine: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many controls, from sorted tables of the free ones: each class of equal codes is a table of its own,
    searched first; the table of all is then only searched for what a mismatch could still win."""
    known = (held >= 0).sum(0)
    classes: dict[tuple, list[int]] = {}
    for i, key in enumerate(map(tuple, held.tolist())):
        classes.setdefault(key, []).append(i)
    tables = {k: (np.array(v), Free(own[v], np.array(v, float))) for k, v in classes.items()}
    place = {int(i): (k, j) for k, (v, _) in tables.items() for j, i in enumerate(v)}
    everyone, chosen, far = Free(own, np.arange(len(own), dtype=float)), [], []
    for q, codes in zip(x, mine, strict=True):
        if not everyone.left:
            break
        counts = [c for c in range(len(codes)) if codes[c] >= 0 and known[c] > 0]

        def penalty(d, at, codes=codes, counts=counts):
            for c in counts:
                d = d + np.where(held[at, c] == codes[c], 0, 2)
            return d

        best, least = (np.inf, np.inf, -1), 0.0
        if counts and len(counts) == len(codes):
            if (key := tuple(codes.tolist())) in tables:
                members, table = tables[key]
                d, rank, j = table.nearest(q, lambda d, at: d, best)
                best = (d, rank, int(members[j])) if j >= 0 else best
            least = 2.0  # for any other class
        found = everyone.nearest(q, penalty, best, least)[2]
        chosen.append(found)
        far.append(penalty(np.sqrt(((own[[found]] - q) ** 2).sum(1)), np.array([found]))[0])
        everyone.take(found)
        cls, j = place[found]
        tables[cls][1].take(j)
        known = known - (held[found] >= 0)
    return np.array(chosen, int), np.array(far, float)


def match_controls(rows: DataFrame, part: str, treated: str, order: list[str], features: list[str], id_col: str, same: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Greedy nearest control without replacement within ``part``: treated rows in ``order`` (descending, then id), Euclid
    over z-scored features, plus 2 for each column of ``same`` that differs (a control without a value differs; a treated
    row without one, or free controls all without one, add nothing). Rows without a feature take no part.

    Parts of up to NEAR controls take their distances from tables of bounded size, larger ones search sorted tables. The
    greedy order is a chain, so a part is one task's.
    """

    def match(rows: pa.Table) -> pa.Table:
        columns = np.stack([rows[f"__x{k}"].to_numpy() for k in range(len(features))])
        whole = ~np.isnan(columns).any(0)
        rows, x = rows.filter(pa.array(whole)), np.ascontiguousarray(columns[:, whole]).T
        sd = x.std(0) if len(x) else np.ones(len(features))
        x = (x - (x.mean(0) if len(x) else 0)) / np.where(sd > 0, sd, 1)
        hot = pc.fill_null(rows[treated], False).to_numpy()
        ordered = pc.sort_indices(rows, [*((f"__o{k}", "descending") for k in range(len(order))), (id_col, "ascending")]).to_numpy()
        ranked = ordered[hot[ordered]]
        by_id = pc.sort_indices(rows, [(id_col, "ascending")]).to_numpy()
        controls = by_id[~hot[by_id]]
        code = lambda c: pc.fill_null(rows[c].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        codes = np.stack([code(f"__s{k}") for k in range(len(same))], 1) if same else np.zeros((len(x), 0), int)
        found, far = (_from_tables if len(controls) <= NEAR else _by_search)(x[ranked], x[controls], codes[ranked], codes[controls])
        of = lambda c, at: rows[c].take(pa.array(at, pa.int64()))
        return pa.table({part: of(part, np.zeros(len(found), int)), "treated_id": of(id_col, ranked[: len(found)]), "control_id": of(id_col, controls[found]), "distance": far})

    kinds = dict(rows.dtypes)
    known = lambda c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("float", "double") else F.col(c)
    named = [*(F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(features)), *(known(c).alias(f"__o{k}") for k, c in enumerate(order)), *(known(c).alias(f"__s{k}") for k, c in enumerate(same))]
    return rows.select(part, treated, id_col, *named).groupBy(part).applyInArrow(match, f"{part} {kinds[part]}, treated_id {kinds[id_col]}, control_id {kinds[id_col]}, distance double")


def sample_per_class(rows: DataFrame, cls: str, n: int, id_col: str, seed: int = 17) -> DataFrame:
    """n rows of each class, drawn by a seeded hash of the id."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(cls).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col))).where(F.col("__n") <= n).drop("__n")
