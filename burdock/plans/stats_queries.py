"""Two-group statistics, corrections, permutations, enrichment and regression over the stand-in cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, counterfactual, enrichment, ordered, stats
from ..sources import shared
from .cohort_queries import _COLLAPSED, burdened
from .registry import query
from .standins import SQL, expression, proteins, rounded, samples, transcripts

#: Long metric table: per sample mean and maximum of p1 and kd.
_LONG = SQL.strip() + """,
m AS (SELECT sample, avg(p1) AS p1_mean, max(kd) AS kd_max FROM prot GROUP BY 1),
long AS (SELECT sample, grp, subject, 'p1_mean' AS metric, p1_mean AS value FROM m JOIN samples USING (sample) UNION ALL SELECT sample, grp, subject, 'kd_max', kd_max FROM m JOIN samples USING (sample)),
r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS rk FROM long),
g AS (SELECT metric, count(*) FILTER (grp = 'AC') AS n_a, count(*) FILTER (grp = 'TOL') AS n_b, avg(value) FILTER (grp = 'AC') AS mean_a, avg(value) FILTER (grp = 'TOL') AS mean_b, median(value) FILTER (grp = 'AC') AS median_a, median(value) FILTER (grp = 'TOL') AS median_b, var_samp(value) FILTER (grp = 'AC') AS var_a, var_samp(value) FILTER (grp = 'TOL') AS var_b, sum(rk) FILTER (grp = 'TOL') AS rb FROM r GROUP BY 1)
"""


def long(spark, sf):
    m = proteins(spark, sf).groupBy("sample").agg(F.avg("p1").alias("p1_mean"), F.max("kd").alias("kd_max"))
    return m.join(samples(spark, sf), "sample").unpivot(["sample", "grp", "subject"], ["p1_mean", "kd_max"], "metric", "value")


@query("two_group_stats", _LONG + "SELECT metric, n_a, n_b, round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b, round(median_a, 9) AS median_a, round(median_b, 9) AS median_b, round(mean_b - mean_a, 9) AS delta_mean, rb - n_b * (n_b + 1) / 2 AS U FROM g")
def two_group(spark, sf):
    out = stats.two_group(long(spark, sf), "AC", "TOL", ["metric"])
    return rounded(out.select("metric", "n_a", "n_b", "mean_a", "mean_b", "median_a", "median_b", "delta_mean", "U"), 9)


@query("cliffs_delta", _LONG + "SELECT a.metric, round(avg(sign(b.value - a.value)), 8) AS cliffs_delta FROM long a JOIN long b ON a.metric = b.metric AND a.grp = 'AC' AND b.grp = 'TOL' GROUP BY 1")
def cliffs(spark, sf):
    return rounded(stats.two_group(long(spark, sf), "AC", "TOL", ["metric"]).select("metric", "cliffs_delta"), 8)


@query("welch_stat", _LONG + "SELECT metric, round((mean_b - mean_a) / sqrt(var_a / n_a + var_b / n_b), 6) AS welch_t, round((var_a / n_a + var_b / n_b) ** 2 / ((var_a / n_a) ** 2 / (n_a - 1) + (var_b / n_b) ** 2 / (n_b - 1)), 6) AS welch_df, round((mean_b - mean_a) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)), 6) AS cohens_d, round((mean_b - mean_a) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) * (1 - 3.0::DOUBLE / (4 * (n_a + n_b - 2) - 1)), 6) AS hedges_g FROM g")
def welch(spark, sf):
    return rounded(stats.two_group(long(spark, sf), "AC", "TOL", ["metric"]).select("metric", "welch_t", "welch_df", "cohens_d", "hedges_g"))


@query("p_values")
def p_values(spark, sf):
    return stats.with_p_values(stats.two_group(long(spark, sf), "AC", "TOL", ["metric"]))


@query("bh_fdr", SQL + "SELECT sample, tx, CASE WHEN p IS NULL THEN NULL ELSE round(least(1, min(p * m / rn) OVER (PARTITION BY sample, p IS NULL ORDER BY p DESC, tx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) END AS fdr FROM (SELECT sample, tx, p, count(*) OVER (PARTITION BY sample, p IS NULL) AS m, row_number() OVER (PARTITION BY sample, p IS NULL ORDER BY p, tx) AS rn FROM (SELECT sample, tx, CASE WHEN counts > 45 THEN NULL ELSE 1 / (1 + counts) END AS p FROM cnt))")
def bh(spark, sf):
    rows = expression(spark, sf).select("sample", "tx", F.when(F.col("counts") <= 45, 1 / (1 + F.col("counts"))).alias("p"))
    return rounded(stats.with_fdr(rows, "p", ["sample"], "tx").select("sample", "tx", "fdr"), 8)


#: Metrics by subject: all samples of a subject are averaged, and labels are dealt out to subjects.
_BY_SUBJECT = _LONG.strip() + """,
subj AS (SELECT metric, subject, grp, avg(value) AS value FROM long GROUP BY 1, 2, 3),
few AS (SELECT metric, list(value ORDER BY subject) AS v, sum(value) AS total, sum(value) FILTER (grp = 'TOL') AS o, count(*) AS n, count(*) FILTER (grp = 'TOL') AS k FROM subj GROUP BY 1),
d AS (SELECT metric, n, k, total, o, """ + " + ".join(f"coalesce(v[{i + 1}], 0) * ((mask >> {i}) & 1)" for i in range(25)) + """ AS p FROM few, range(33554432) t(mask) WHERE bit_count(mask) = k AND mask < 2 ** n),
e AS (SELECT metric, p / k - (total - p) / (n - k) AS d, o / k - (total - o) / (n - k) AS obs FROM d)
"""


@query("exact_permutation", _BY_SUBJECT + "SELECT metric, count(*) AS n_permutations, round((count(*) FILTER (d >= obs - 1e-9) + 1)::DOUBLE / (count(*) + 1), 8) AS p_greater, round((count(*) FILTER (abs(d) >= abs(obs) - 1e-9) + 1)::DOUBLE / (count(*) + 1), 8) AS p_two_sided FROM e GROUP BY 1")
def exact_permutation(spark, sf):
    """All samples, averaged by subject: few enough units for every way to deal out the labels."""
    units = long(spark, sf).groupBy("metric", "subject", "grp").agg(F.avg("value").alias("value"))
    return rounded(stats.exact_permutation(spark, units, "AC", "TOL", ["metric"], "subject", tolerance=1e-9).drop("delta", "exact"), 8)


_DEALT = _LONG.strip() + """,
size AS (SELECT metric, count(*) FILTER (grp = 'TOL') AS k, avg(value) FILTER (grp = 'TOL') - avg(value) FILTER (grp = 'AC') AS obs, count(*) AS n FROM long GROUP BY 1),
dealt AS (SELECT metric, deal, value, row_number() OVER (PARTITION BY metric, deal ORDER BY md5(deal || ':' || sample)) AS r FROM long, range(10000) t(deal)),
e AS (SELECT metric, deal, avg(value) FILTER (r <= k) - avg(value) FILTER (r > k) AS d, any_value(obs) AS obs FROM dealt JOIN size USING (metric) GROUP BY 1, 2)
"""


@query("label_permutation", _DEALT + "SELECT metric, count(*) AS n_permutations, round(any_value(obs), 8) AS delta, round((count(*) FILTER (d >= obs - 1e-9) + 1)::DOUBLE / (count(*) + 1), 8) AS p_greater, round((count(*) FILTER (abs(d) >= abs(obs) - 1e-9) + 1)::DOUBLE / (count(*) + 1), 8) AS p_two_sided FROM e GROUP BY 1")
def label_permutation(spark, sf):
    """All samples, by random deals at every size."""
    return rounded(stats.exact_permutation(spark, long(spark, sf), "AC", "TOL", ["metric"], "sample", tolerance=1e-9, most=0).drop("exact"), 8)


@query("logcpm_de", SQL + "SELECT tx, round(avg(logcpm) FILTER (grp = 'TOL') - avg(logcpm) FILTER (grp = 'AC'), 6) AS log2fc, count(*) AS n FROM (SELECT tx, grp, log2(counts * 1e6 / sum(counts) OVER (PARTITION BY sample) + 1) AS logcpm, counts FROM cnt JOIN samples USING (sample)) GROUP BY 1 HAVING count(*) FILTER (counts >= 10) >= 3")
def logcpm(spark, sf):
    rows = stats.log_cpm(expression(spark, sf)).join(samples(spark, sf), "sample")
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("logcpm")))
    return rounded(rows.groupBy("tx").agg((mean("TOL") - mean("AC")).alias("log2fc"), F.count("*").alias("n"), F.count_if(F.col("counts") >= 10).alias("k")).where("k >= 3").drop("k"))


@query("gsea_running_sum", SQL + "SELECT sample, round(CASE WHEN abs(max(run)) >= abs(min(run)) THEN max(run) ELSE min(run) END, 6) AS es, count(*) FILTER (hit) AS n_hits, count(*) AS n FROM (SELECT sample, hit, sum(CASE WHEN hit THEN counts / nullif(power, 0) ELSE -1.0::DOUBLE / misses END) OVER (PARTITION BY sample ORDER BY counts DESC, tx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT sample, tx, counts, tx % 7 = 0 AS hit, sum(counts) FILTER (tx % 7 = 0) OVER (PARTITION BY sample) AS power, count(*) FILTER (tx % 7 <> 0) OVER (PARTITION BY sample) AS misses FROM cnt)) GROUP BY 1")
def gsea(spark, sf):
    return rounded(enrichment.enrichment_scores(expression(spark, sf).withColumn("hit", F.col("tx") % 7 == 0), ["sample"], "counts", "hit", "tx"))


@query("spearman", SQL + "SELECT sample, count(*) AS n, round(corr(p1, kd), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY p1) + (count(*) OVER (PARTITION BY sample, p1) - 1) / 2 AS rx, rank() OVER (PARTITION BY sample ORDER BY kd) + (count(*) OVER (PARTITION BY sample, kd) - 1) / 2 AS ry FROM prot) GROUP BY 1")
def spearman(spark, sf):
    return rounded(stats.rank_correlation(proteins(spark, sf), "p1", "kd", ["sample"]).drop("t"))


_OLS = SQL.strip() + """,
g AS (SELECT grp, count(*) AS n, regr_slope(kd, p1) AS b, regr_intercept(kd, p1) AS a, regr_sxx(kd, p1) AS sxx, regr_syy(kd, p1) - regr_sxy(kd, p1) ** 2 / regr_sxx(kd, p1) AS rss, avg(p1) AS mx FROM prot JOIN samples USING (sample) GROUP BY 1),
s AS (SELECT sum(rss) / (sum(n) - 4) AS s2, sum(rss) AS rss, max(a) FILTER (grp = 'AC') AS a0, max(a) FILTER (grp = 'TOL') AS a1, max(b) FILTER (grp = 'AC') AS b0, max(b) FILTER (grp = 'TOL') AS b1,
  max(1 / n + mx * mx / sxx) FILTER (grp = 'AC') AS va0, max(1 / n + mx * mx / sxx) FILTER (grp = 'TOL') AS va1, max(1 / sxx) FILTER (grp = 'AC') AS vb0, max(1 / sxx) FILTER (grp = 'TOL') AS vb1 FROM g),
t AS (SELECT unnest(['intercept', 'p1', 'tol', 'p1_tol']) AS term, unnest([a0, b0, a1 - a0, b1 - b0]) AS coef, unnest([sqrt(s2 * va0), sqrt(s2 * vb0), sqrt(s2 * (va0 + va1)), sqrt(s2 * (vb0 + vb1))]) AS se FROM s)
SELECT term, round(coef, 5) AS coef, round(se, 5) AS se, round(coef / se, 3) AS t, (SELECT round(1 - any_value(s.rss) / regr_syy(kd, p1), 6) FROM prot JOIN samples USING (sample), s) AS r2 FROM t"""


def _fit(spark, sf):
    rows = proteins(spark, sf).join(samples(spark, sf).select("sample", (F.col("grp") == "TOL").cast("double").alias("tol")), "sample")
    return stats.ols(spark, rows.withColumn("p1_tol", F.col("p1") * F.col("tol")), "kd", ["p1", "tol", "p1_tol"])


@query("ols_interaction", _OLS)
def ols_interaction(spark, sf):
    return _fit(spark, sf).select("term", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"), F.round("t", 3).alias("t"), F.round("r2", 6).alias("r2"))


@query("ols_p_values")
def ols_p_values(spark, sf):
    return _fit(spark, sf).select("term", "p")


@query("correlation_difference", SQL + ", r AS (SELECT grp, p1, kd, rank() OVER (PARTITION BY grp ORDER BY p1) + (count(*) OVER (PARTITION BY grp, p1) - 1) / 2 AS rx, rank() OVER (PARTITION BY grp ORDER BY kd) + (count(*) OVER (PARTITION BY grp, kd) - 1) / 2 AS ry FROM prot JOIN samples USING (sample)), c AS (SELECT corr(p1, kd) FILTER (grp = 'AC') AS pa, corr(p1, kd) FILTER (grp = 'TOL') AS pb, corr(rx, ry) FILTER (grp = 'AC') AS sa, corr(rx, ry) FILTER (grp = 'TOL') AS sb FROM r) SELECT round(pa, 6) AS pearson_a, round(pb, 6) AS pearson_b, round(sa, 6) AS spearman_a, round(sb, 6) AS spearman_b, round(pb - pa, 6) AS pearson_diff, round(sb - sa, 6) AS spearman_diff, round(atanh(pb) - atanh(pa), 6) AS fisher_z_diff FROM c")
def correlation_difference(spark, sf):
    rows = proteins(spark, sf).join(samples(spark, sf).select("sample", "grp"), "sample")
    return rounded(stats.correlation_difference(rows, "p1", "kd", "AC", "TOL"))


@query("average_sd_d", _LONG + "SELECT metric, round((mean_a - mean_b) / sqrt((var_a + var_b) / 2), 6) AS cohens_d_average FROM g")
def average_sd_d(spark, sf):
    return rounded(stats.average_sd_d(stats.two_group(long(spark, sf), "AC", "TOL", ["metric"])).select("metric", "cohens_d_average"))


@query("de_table", SQL + ", l AS (SELECT tx, grp, counts, log2(counts * 1e6 / sum(counts) OVER (PARTITION BY sample) + 1) AS x FROM cnt JOIN samples USING (sample)), s AS (SELECT tx, avg(counts) AS mean_counts, avg(x) FILTER (grp = 'TOL') - avg(x) FILTER (grp = 'AC') AS log2fc, var_samp(x) FILTER (grp = 'AC') / count(*) FILTER (grp = 'AC') + var_samp(x) FILTER (grp = 'TOL') / count(*) FILTER (grp = 'TOL') AS se2 FROM l GROUP BY 1 HAVING count(*) FILTER (counts >= 10) >= 3) SELECT tx, round(mean_counts, 6) AS mean_counts, round(log2fc, 6) AS log2fc, round(log2fc / nullif(sqrt(se2), 0), 6) AS welch_t FROM s")
def de_table(spark, sf):
    rows = expression(spark, sf).join(samples(spark, sf).select("sample", "grp"), "sample")
    return rounded(stats.de_table(rows, "AC", "TOL", "tx").drop("p", "fdr"))


_SETS = SQL + ", l AS (SELECT tx, grp, log2(counts * 1e6 / sum(counts) OVER (PARTITION BY sample) + 1) AS x FROM cnt JOIN samples USING (sample)), v AS (SELECT tx, round(avg(x) FILTER (grp = 'TOL') - avg(x) FILTER (grp = 'AC'), 9) AS value, tx % 7 = 0 AS hot FROM l GROUP BY 1 HAVING value IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM v)"


def _folds(spark, sf):
    rows = stats.log_cpm(expression(spark, sf)).join(samples(spark, sf).select("sample", "grp"), "sample")
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("logcpm")))
    return rows.groupBy("tx").agg(F.round(mean("TOL") - mean("AC"), 9).alias("value")).withColumn("hot", F.col("tx") % 7 == 0)


@query("competitive_set", _SETS + "SELECT count(*) FILTER (hot) AS n_set, count(*) FILTER (NOT hot) AS n_background, round(avg(value) FILTER (hot), 6) AS mean_set, round(avg(value) FILTER (NOT hot), 6) AS mean_background, round(avg(value) FILTER (hot) - avg(value) FILTER (NOT hot), 6) AS mean_difference, sum(rk) FILTER (hot) - count(*) FILTER (hot) * (count(*) FILTER (hot) + 1) / 2 AS U, round((sum(rk) FILTER (hot) - count(*) FILTER (hot) * (count(*) FILTER (hot) + 1) / 2) / (count(*) FILTER (hot) * count(*) FILTER (NOT hot)), 6) AS auc FROM r")
def competitive_set(spark, sf):
    return rounded(stats.competitive_set(_folds(spark, sf), "hot").drop("ties"))


@query("random_sets")
def random_sets(spark, sf):
    return stats.random_sets(_folds(spark, sf), "hot")


@query("bootstrap_effects")
def bootstrap_effects(spark, sf):
    return stats.bootstrap_effects(long(spark, sf), "AC", "TOL", ["metric"])


@query("bootstrap_coupling")
def bootstrap_coupling(spark, sf):
    wide = long(spark, sf).groupBy("sample", "grp").pivot("metric", ["p1_mean", "kd_max"]).agg(F.first("value")).withColumn("k", F.lit(1))
    return stats.bootstrap_effects(wide, "AC", "TOL", ["k"], "p1_mean", "kd_max").drop("k")


@query("hc3_contrast", _LONG + "SELECT metric, round(max(mv) FILTER (grp = 'AC') - max(mv) FILTER (grp = 'TOL'), 6) AS contrast, round(sqrt(sum(vp * n / ((n - 1) * (n - 1)))), 6) AS se_hc3 FROM (SELECT metric, grp, count(*) AS n, avg(value) AS mv, var_pop(value) AS vp FROM long GROUP BY 1, 2) GROUP BY 1")
def hc3(spark, sf):
    return rounded(stats.hc3_contrast(long(spark, sf), "AC", "TOL", ["metric"]))


@query("risk_votes", _LONG + "SELECT sample, grp, CAST(p1_mean > max(p1_mean) FILTER (grp = 'AC') OVER () AS INT) AS vote_p1_mean, CAST(kd_max > max(kd_max) FILTER (grp = 'AC') OVER () AS INT) AS vote_kd_max, CAST(p1_mean > max(p1_mean) FILTER (grp = 'AC') OVER () AS INT) + CAST(kd_max > max(kd_max) FILTER (grp = 'AC') OVER () AS INT) AS votes FROM m JOIN samples USING (sample)")
def risk_votes(spark, sf):
    m = proteins(spark, sf).groupBy("sample").agg(F.avg("p1").alias("p1_mean"), F.max("kd").alias("kd_max")).join(samples(spark, sf), "sample")
    return stats.risk_votes(m, "AC", ["p1_mean", "kd_max"], []).drop("vote_fraction")


@query("leave_one_out", _LONG + ", u AS (SELECT DISTINCT metric, subject FROM long) SELECT u.metric, u.subject, round(CASE WHEN count(*) FILTER (grp = 'AC') >= 2 AND count(*) FILTER (grp = 'TOL') >= 2 THEN avg(value) FILTER (grp = 'TOL') - avg(value) FILTER (grp = 'AC') END, 9) AS delta_without FROM u JOIN long l ON u.metric = l.metric AND u.subject <> l.subject GROUP BY 1, 2")
def leave_one_out(spark, sf):
    return rounded(stats.leave_one_out(long(spark, sf), "subject", "AC", "TOL", ["metric"]), 9)


_TAIL = "list_sum(list_transform(range({k}, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))))"
_SIGNS = SQL + ", ge AS (SELECT sample, gene, sum(tpm) AS v FROM expr JOIN tx USING (tx) GROUP BY 1, 2), m AS (SELECT gene, median(v) FILTER (grp = 'TOL') AS b, median(v) FILTER (grp = 'AC') AS a FROM ge JOIN samples USING (sample) GROUP BY 1), c AS (SELECT count(*) FILTER (b > a) AS k, count(*) FILTER (b <> a) AS n FROM m)"
_BISECT = (
    _SIGNS.replace("WITH samples", "WITH RECURSIVE samples") + ", lo AS (SELECT k, n, 0.0::DOUBLE AS l, 1.0::DOUBLE AS h, 0 AS i FROM c UNION ALL SELECT k, n, CASE WHEN t < 0.025 THEN (l + h) / 2 ELSE l END, CASE WHEN t < 0.025 THEN h ELSE (l + h) / 2 END, i + 1 FROM (SELECT *, " + _TAIL.format(k="k", p="((l + h) / 2)") + " AS t FROM lo WHERE i < 50))"
    + ", hi AS (SELECT k, n, 0.0::DOUBLE AS l, 1.0::DOUBLE AS h, 0 AS i FROM c UNION ALL SELECT k, n, CASE WHEN t < 0.975 THEN (l + h) / 2 ELSE l END, CASE WHEN t < 0.975 THEN h ELSE (l + h) / 2 END, i + 1 FROM (SELECT *, " + _TAIL.format(k="k + 1", p="((l + h) / 2)") + " AS t FROM hi WHERE i < 50))"
)


@query("directional_replication", _BISECT + " SELECT k, n, round(" + _TAIL.format(k="k", p="0.5") + ", 6) AS p, round(CASE WHEN k = 0 THEN 0 ELSE (SELECT l FROM lo WHERE i = 50) END, 6) AS low, round(CASE WHEN k = n THEN 1 ELSE (SELECT l FROM hi WHERE i = 50) END, 6) AS high FROM c")
def directional(spark, sf):
    g = expression(spark, sf).join(transcripts(spark, sf), "tx").groupBy("sample", "gene").agg(F.sum("tpm").alias("value")).join(samples(spark, sf), "sample")
    d = stats.two_group(g, "AC", "TOL", ["gene"]).withColumn("up", F.col("median_b") > F.col("median_a")).agg(F.count_if("up").alias("k"), F.count_if(F.col("median_b") != F.col("median_a")).alias("n"))
    p, ci = stats.sign_test(spark, F.col("k"), F.col("n"))
    return rounded(d.select("k", "n", p.alias("p"), ci.alias("ci")).select("k", "n", "p", "ci.low", "ci.high"))


@query("bootstrap_ci")
def bootstrap(spark, sf):
    return stats.resample(long(spark, sf), "AC", "TOL", ["metric"])


@query("within_bin_permutation")
def within_bins(spark, sf):
    rows = expression(spark, sf).join(transcripts(spark, sf), "tx").withColumns({"bin": cohort.quantile_bin("len", "sample", "tx"), "hot": F.col("tx") % 5 == 0})
    return stats.permute_within(spark, rows, ["bin"], "hot", "tpm", "sample", 10_000)


def counterfactual_rows(spark, sf):
    """Rows of all samples and transcripts with a known protein, and the samples with their coverage."""
    once = f"{shared.folder(spark)}/burdened"  # read several times below
    burdened(spark, sf).select("sample", "tx", "tpm", "score", "positive", "len").write.parquet(once)
    whole = spark.read.parquet(once)
    covered = whole.groupBy("sample").agg((cohort.share(F.sum(F.when(F.col("score").isNotNull(), F.col("tpm"))), F.sum("tpm")) >= 0.5).alias("covered"))
    known = whole.where("score is not null").select("sample", F.col("tx").alias("id"), "tpm", F.col("score").alias("index"), F.col("positive").alias("strict"), F.col("len").alias("length"))
    mean = known.groupBy("id").agg(F.log2(F.avg("tpm") + 1e-6).alias("expression"))
    who = samples(spark, sf).select("sample", "grp").join(covered, "sample").select("sample", "grp", F.lit(True).alias("all_samples"), F.coalesce("covered", F.lit(False)).alias("covered"))
    return known.join(mean, "id"), who


@query("counterfactual_null")
def counterfactual_null(spark, sf):
    """Five endpoints, bins of length and expression, 10,000 permutations of (index, label)."""
    return rounded(counterfactual.counterfactual_null(*counterfactual_rows(spark, sf), ["all_samples", "covered"]), 9)


_OBSERVED = _COLLAPSED + """, w AS (SELECT sample, coalesce(sum(tpm) FILTER (score IS NOT NULL), 0) / sum(tpm) >= 0.5 AS covered FROM joined GROUP BY 1),
k AS (SELECT sample, tpm, score, positive::INT AS hot FROM joined WHERE score IS NOT NULL),
e AS (SELECT sample, sum(tpm * hot) / sum(tpm) AS strict_fraction, sum(tpm * hot) AS strict_tpm, count(*) FILTER (hot = 1 AND tpm >= 1)::DOUBLE AS n_strict_expressed, sum(tpm * score * hot) AS strict_weighted_sum, sum(tpm * score) / sum(tpm) AS weighted_index FROM k GROUP BY 1),
l AS (UNPIVOT (SELECT * FROM e) ON strict_fraction, strict_tpm, n_strict_expressed, strict_weighted_sum, weighted_index INTO NAME metric VALUE v),
s AS (SELECT metric, v, grp, unnest(CASE WHEN covered THEN ['all_samples', 'covered'] ELSE ['all_samples'] END) AS analysis_set FROM l JOIN w USING (sample) JOIN samples USING (sample))
SELECT analysis_set, metric, round(avg(v) FILTER (grp = 'TOL') - avg(v) FILTER (grp = 'AC'), 6) AS observed_delta FROM s GROUP BY 1, 2"""


@query("counterfactual_observed", _OBSERVED)
def counterfactual_observed(spark, sf):
    """The differences that the permutations are held against, by the same weights and chunks."""
    rows, who = counterfactual_rows(spark, sf)
    keyed = counterfactual.first_rank_bin(counterfactual.first_rank_bin(rows, "length", ["sample", "id"], "lb", 5), "expression", ["sample", "id"], "eb", 5)
    sets = ["all_samples", "covered"]
    wide = counterfactual.null_differences(keyed, who, sets, "AC", "TOL", ["lb", "eb"], 0)
    named = [F.struct(F.lit(s).alias("analysis_set"), F.lit(m).alias("metric"), F.round(F.col(f"d{5 * i + j}"), 6).alias("observed_delta")) for i, s in enumerate(sets) for j, m in enumerate(counterfactual.ENDPOINTS)]
    return wide.select(F.explode(F.array(*named)).alias("x")).select("x.*")


@query("signed_fdr", SQL + ", p AS (SELECT sample, tx, CASE WHEN counts > 45 THEN NULL ELSE 1 / (1 + counts::DOUBLE) END AS p, counts - 25 AS effect FROM cnt), q AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, sample, tx) AS rn FROM p WHERE p IS NOT NULL), f AS (SELECT sample, tx, least(1, min(p * m / rn) OVER (ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM q) SELECT p.sample, p.tx, round(sign(effect) * -log10(coalesce(fdr, 1)), 8) + 0 AS signed FROM p LEFT JOIN f USING (sample, tx)")
def signed_fdr(spark, sf):
    """The step-up over the whole table at once, and its signed logarithm."""
    rows = expression(spark, sf).select("sample", "tx", F.when(F.col("counts") <= 45, 1 / (1 + F.col("counts").cast("double"))).alias("p"), (F.col("counts") - 25).cast("double").alias("effect"))
    out = ordered.step_up(rows, "p")
    return out.select("sample", "tx", (F.round(stats.signed_p(F.col("effect"), F.col("fdr")), 8) + 0).alias("signed"))


@query("count_matrix", SQL + "SELECT gene, " + ", ".join(f"coalesce(round(sum(counts) FILTER (sample = {s})), 0)::BIGINT AS \"{s}\"" for s in (5, 1, 3)) + " FROM cnt JOIN tx USING (tx) WHERE sample IN (5, 1, 3) GROUP BY 1")
def count_matrix(spark, sf):
    """Whole counts of genes by chosen samples, as an outside test reads them."""
    return stats.count_matrix(expression(spark, sf).join(transcripts(spark, sf), "tx"), [5, 1, 3])


def _genes(spark, sf):
    """Log expression of genes by sample, and sets of genes by their last digit."""
    tx = transcripts(spark, sf)
    rows = expression(spark, sf).join(tx, "tx").groupBy("sample", "gene").agg(F.log2(F.sum("tpm") + 1).alias("value"))
    return rows, tx.select(F.concat(F.lit("set"), F.expr("right(gene, 1)")).alias("signature"), "gene").distinct()


_GENES = SQL.strip() + ", ge AS (SELECT sample, gene, round(log2(sum(tpm) + 1), 9) AS value FROM expr JOIN tx USING (tx) GROUP BY 1, 2), sets AS (SELECT DISTINCT 'set' || substr(gene, length(gene), 1) AS signature, gene FROM tx)"


@query("single_sample_enrichment", _GENES + ", k AS (SELECT sample, gene, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS pos, count(*) OVER (PARTITION BY sample) AS n FROM ge), f AS (SELECT k.*, s.signature, EXISTS (SELECT 1 FROM sets z WHERE z.signature = s.signature AND z.gene = k.gene) AS hit FROM k, (SELECT DISTINCT signature FROM sets) s), st AS (SELECT *, CASE WHEN hit THEN (n - pos + 1)::DOUBLE ** 0.25 / sum(CASE WHEN hit THEN (n - pos + 1)::DOUBLE ** 0.25 END) OVER (PARTITION BY sample, signature) ELSE -1.0::DOUBLE / count(*) FILTER (NOT hit) OVER (PARTITION BY sample, signature) END AS step FROM f), run AS (SELECT *, sum(step) OVER (PARTITION BY sample, signature ORDER BY pos) AS r FROM st), es AS (SELECT sample, signature, count(*) FILTER (hit) AS n_genes, sum(r) AS es FROM run GROUP BY 1, 2) SELECT sample, signature, n_genes, round(es, 5) AS es, round(es / (max(es) OVER () - min(es) OVER ()), 5) AS nes FROM es WHERE n_genes > 0")
def single_sample_enrichment(spark, sf):
    rows, sets = _genes(spark, sf)
    return rounded(enrichment.single_sample(rows.withColumn("value", F.round("value", 9)), sets), 5)


@query("gene_set_variation")
def gene_set_variation(spark, sf):
    return rounded(enrichment.variation(*_genes(spark, sf)), 5)


@query("enrichment_test")
def enrichment_test(spark, sf):
    rows, sets = _genes(spark, sf)
    return rounded(enrichment.enrichment_test(spark, rows, samples(spark, sf), sets, "AC", "TOL", 10_000))
