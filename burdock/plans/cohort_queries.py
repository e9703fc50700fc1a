"""Merging, collapse, burden, ranks, reshaping and set operations over the stand-in cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import cohort, ordered
from ..schema import ENSEMBLE_CUTS, SIXMER_CUTS, STRINGENT_CUTS
from .registry import query
from .standins import SQL, expression, proteins, read, rounded, samples, transcripts

_CONS = "CASE WHEN l1 = l2 THEN l1 ELSE 'Discordant' END"
_COLLAPSED = SQL.strip() + f""",
col AS (SELECT sample, tx, max(p1) AS p1_max, max(p2) AS p2_max, avg(kd) AS kd_mean, count(DISTINCT protein_id) AS n_proteins, min(CASE {_CONS} WHEN 'Amyloid' THEN 1 WHEN 'Partial' THEN 2 WHEN 'Discordant' THEN 3 ELSE 4 END) AS o FROM pred GROUP BY 1, 2),
joined AS (SELECT e.sample, e.tx, e.tpm, t.gene, CASE WHEN t.biotype = 'protein_coding' THEN c.p1_max END AS score, t.biotype = 'protein_coding' AND c.o = 1 AS positive, c.p1_max, c.p2_max FROM expr e JOIN tx t USING (tx) LEFT JOIN col c USING (sample, tx))
"""


def predicted(spark, sf):
    p = proteins(spark, sf)
    lab = lambda c: F.when(F.col(c) > 0.5, "Amyloid").otherwise("Non-Amyloid")
    return p.withColumns({"l1": lab("p1"), "l2": lab("p2")}).withColumn("consensus", labels.consensus(F.col("l1"), F.col("l2")))


def collapsed(spark, sf):
    return cohort.collapse(predicted(spark, sf), ["sample", "tx"], ["kd"], ["p1", "p2"], "consensus", "protein_id")


def burdened(spark, sf):
    rows = expression(spark, sf).join(transcripts(spark, sf), "tx").join(collapsed(spark, sf), ["sample", "tx"], "left")
    coding = F.col("biotype") == "protein_coding"
    return rows.withColumns({"score": F.when(coding, F.col("p1_max")), "positive": coding & (F.col("consensus") == "Amyloid")})


_MERGED = """WITH a AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS prob, CASE o_orderstatus WHEN 'F' THEN 'AMYL' WHEN 'O' THEN 'non_amyloid' END AS pred FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS id, o_totalprice / 400000 AS prob, CASE WHEN o_totalprice > 150000 THEN ' Amyloid ' ELSE 'Non-Amyloid' END AS pred FROM orders WHERE o_orderkey % 4 <> 0),
c AS (SELECT o_orderkey AS id, o_totalprice / 300000 AS prob, CASE WHEN o_custkey % 2 = 0 THEN 'amyloidogenic' ELSE 'not-amyloid' END AS pred FROM orders WHERE o_orderkey % 5 <> 0),
n AS (SELECT id, a.prob AS a_prob, b.prob AS b_prob, c.prob AS c_prob, CASE a.pred WHEN 'AMYL' THEN 'Amyloid' WHEN 'non_amyloid' THEN 'Non-Amyloid' ELSE 'NA' END AS a_pred, CASE b.pred WHEN ' Amyloid ' THEN 'Amyloid' WHEN 'Non-Amyloid' THEN 'Non-Amyloid' ELSE 'NA' END AS b_pred, CASE c.pred WHEN 'amyloidogenic' THEN 'Amyloid' WHEN 'not-amyloid' THEN 'Non-Amyloid' ELSE 'NA' END AS c_pred FROM a FULL JOIN b USING (id) FULL JOIN c USING (id))
SELECT *, CASE WHEN a_pred = 'NA' AND b_pred = 'NA' AND c_pred = 'NA' THEN 'NA' WHEN 'Amyloid' IN (a_pred, b_pred, c_pred) AND 'Non-Amyloid' IN (a_pred, b_pred, c_pred) THEN 'Discordant' WHEN 'NA' IN (a_pred, b_pred, c_pred) THEN 'Partial' ELSE a_pred END AS consensus FROM n"""


@query("merge_predictors_3way", _MERGED)
def merge_predictors(spark, sf):
    o = read(spark, sf, "orders")
    price = F.col("o_totalprice")
    make = lambda m, div, pred: o.where(F.col("o_orderkey") % m != 0).select(F.col("o_orderkey").alias("id"), (price / div).alias("prob"), pred.alias("pred"))
    return cohort.merge_predictions({
        "a": make(3, 500000, F.when(F.col("o_orderstatus") == "F", "AMYL").when(F.col("o_orderstatus") == "O", "non_amyloid")),
        "b": make(4, 400000, F.when(price > 150000, " Amyloid ").otherwise("Non-Amyloid")),
        "c": make(5, 300000, F.when(F.col("o_custkey") % 2 == 0, "amyloidogenic").otherwise("not-amyloid")),
    })


@query("consensus_collapse_priority", _COLLAPSED + "SELECT sample, tx, p1_max, p2_max, round(kd_mean, 9) AS kd_mean, n_proteins, CASE o WHEN 1 THEN 'Amyloid' WHEN 2 THEN 'Partial' WHEN 3 THEN 'Discordant' ELSE 'Non-Amyloid' END AS consensus FROM col")
def consensus_collapse(spark, sf):
    return rounded(collapsed(spark, sf), 9)


def _cut(col: str, cuts, strict=False) -> str:
    hi, lo = (">", "<") if strict else (">=", "<=")
    return f"CASE WHEN {col} {hi} {cuts[1]} THEN 'Amyloidogenic' WHEN {col} {lo} {cuts[0]} THEN 'Non-Amyloidogenic' ELSE 'Intermediate' END"


@query("prob_class_q17q83", SQL + f"SELECT c1, c2, CASE WHEN c1 = c2 THEN c1 ELSE 'Intermediate' END AS joint, s1, count(*) AS n FROM (SELECT {_cut('p1', SIXMER_CUTS)} AS c1, {_cut('p2', ENSEMBLE_CUTS)} AS c2, {_cut('p1', STRINGENT_CUTS, True)} AS s1 FROM prot) GROUP BY 1, 2, 3, 4")
def prob_class(spark, sf):
    c = proteins(spark, sf).select(labels.by_cuts(F.col("p1"), SIXMER_CUTS).alias("c1"), labels.by_cuts(F.col("p2"), ENSEMBLE_CUTS).alias("c2"), labels.by_cuts(F.col("p1"), STRINGENT_CUTS, True).alias("s1"))
    return c.withColumn("joint", labels.joint(F.col("c1"), F.col("c2"))).groupBy("c1", "c2", "joint", "s1").agg(F.count("*").alias("n"))


@query("sample_burden", _COLLAPSED + "SELECT sample, round(total, 4) AS total_TPM, round(ann, 4) AS annotated_TPM, round(str, 4) AS strict_TPM, round(ws, 4) AS weighted_sum, n_strict_expressed, n_annotated_expressed, round(ann / nullif(total, 0), 4) AS annotation_fraction, round(str / nullif(ann, 0), 4) AS strict_fraction, round(ws / nullif(ann, 0), 4) AS weighted_index, ann / nullif(total, 0) >= 0.5 AS keep_coverage FROM (SELECT sample, sum(tpm) AS total, coalesce(sum(tpm) FILTER (score IS NOT NULL), 0) AS ann, coalesce(sum(tpm) FILTER (positive), 0) AS str, coalesce(sum(score * tpm), 0) AS ws, count(*) FILTER (positive AND tpm >= 1) AS n_strict_expressed, count(*) FILTER (score IS NOT NULL AND tpm >= 1) AS n_annotated_expressed FROM joined GROUP BY 1)")
def sample_burden(spark, sf):
    return rounded(cohort.sample_burden(burdened(spark, sf)), 4)


@query("class_burden_zero_filled", _COLLAPSED + f", cls AS (SELECT sample, tpm, {_cut('p1_max', SIXMER_CUTS)} AS sixmer, {_cut('p2_max', ENSEMBLE_CUTS)} AS ensemble FROM joined), long AS (SELECT sample, log2(tpm + 1) AS w, 'sixmer' AS predictor, sixmer AS class FROM cls UNION ALL SELECT sample, log2(tpm + 1), 'ensemble', ensemble FROM cls), grid AS (SELECT * FROM (SELECT sample, sum(log2(tpm + 1)) AS whole FROM cls GROUP BY 1), (VALUES ('sixmer'), ('ensemble')) p(predictor), (VALUES ('Amyloidogenic'), ('Intermediate'), ('Non-Amyloidogenic')) c(class)) SELECT sample, predictor, class, round(coalesce(sum(w), 0), 4) AS burden, round(coalesce(sum(w) / any_value(whole), 0), 6) AS share, count(w) AS n FROM grid LEFT JOIN long USING (sample, predictor, class) GROUP BY 1, 2, 3")
def class_burden(spark, sf):
    rows = burdened(spark, sf).select("sample", "tpm", labels.by_cuts(F.col("p1_max"), SIXMER_CUTS).alias("sixmer"), labels.by_cuts(F.col("p2_max"), ENSEMBLE_CUTS).alias("ensemble"))
    out = cohort.class_burden(rows, ["sixmer", "ensemble"])
    return out.withColumns({"burden": F.round("burden", 4), "share": F.round("share", 6)})


@query("class_burden_hydropathy", _COLLAPSED + f", kd AS (SELECT sample, tx, max(kd) AS kd FROM prot GROUP BY 1, 2), cls AS (SELECT sample, log2(tpm + 1) AS w, log2(tpm + 1) * kd AS k, {_cut('p1_max', SIXMER_CUTS)} AS class FROM joined JOIN kd USING (sample, tx)), c AS (SELECT unnest(['Amyloidogenic', 'Intermediate', 'Non-Amyloidogenic']) AS class), g AS (SELECT sample, sum(k) AS whole FROM cls GROUP BY 1) SELECT g.sample, c.class, round(coalesce(sum(k) / any_value(whole), 0), 6) AS hydropathy_share FROM g CROSS JOIN c LEFT JOIN cls ON cls.sample = g.sample AND cls.class = c.class GROUP BY 1, 2")
def class_burden_hydropathy(spark, sf):
    """Shares of the classes, each row weighted by its transcript's largest hydropathy."""
    kd = proteins(spark, sf).groupBy("sample", "tx").agg(F.max("kd").alias("kd"))
    rows = burdened(spark, sf).join(kd, ["sample", "tx"]).select("sample", "tpm", "kd", labels.by_cuts(F.col("p1_max"), SIXMER_CUTS).alias("sixmer"))
    return cohort.class_burden(rows, ["sixmer"], hydropathy="kd").select("sample", "class", F.round("hydropathy_share", 6).alias("hydropathy_share"))


@query("gene_sum", SQL + "SELECT gene, round(sum(tpm), 4) AS tpm, count(DISTINCT tx) AS n FROM expr JOIN tx USING (tx) GROUP BY 1")
def gene_sum(spark, sf):
    return rounded(expression(spark, sf).join(transcripts(spark, sf), "tx").groupBy("gene").agg(F.sum("tpm").alias("tpm"), F.countDistinct("tx").alias("n")), 4)


@query("top_contributors", SQL + "SELECT sample, tx, round(tpm, 4) AS tpm, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY counts DESC, tx) AS rank FROM expr) WHERE rank <= 5")
def top_contributors(spark, sf):
    return rounded(cohort.top_rows(expression(spark, sf), "counts", "sample", 5, "tx").select("sample", "tx", "tpm", "rank"), 4)


@query("tail_top1pct_mass", SQL + "SELECT sample, round(quantile_cont(kd, 0.9), 9) AS q90, round(quantile_cont(kd, 0.95), 9) AS q95, round(sum(kd) FILTER (rn <= greatest(1, ceil(n * 0.01))), 9) AS top_mass FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY kd DESC) AS rn, count(*) OVER (PARTITION BY sample) AS n FROM prot) GROUP BY 1")
def tail_mass(spark, sf):
    return rounded(cohort.tails(proteins(spark, sf), "kd"), 9)


@query("gini_topshare", SQL + "SELECT sample, round(CASE WHEN count(*) = 1 THEN 0 ELSE 2 * sum(up * kd) / (count(*) * sum(kd)) - (count(*) + 1) / count(*) END, 6) AS gini, " + ", ".join(f"round(coalesce(sum(kd) FILTER (down <= {k}) / sum(kd), 0), 6) AS top{k}_share" for k in (1, 5, 10)) + " FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY kd) AS up, row_number() OVER (PARTITION BY sample ORDER BY kd DESC) AS down FROM prot WHERE kd > 0) GROUP BY 1")
def gini(spark, sf):
    return rounded(cohort.concentration(proteins(spark, sf), "kd"))


@query("rank_percentile_signature", SQL + "SELECT sample, tx, round((rank() OVER (PARTITION BY sample ORDER BY counts) + (count(*) OVER (PARTITION BY sample, counts) - 1) / 2 - 1) / nullif(count(*) OVER (PARTITION BY sample) - 1, 0), 8) AS pct FROM cnt")
def rank_percentile(spark, sf):
    return rounded(expression(spark, sf).select("sample", "tx", cohort.rank_percentile("counts", "sample").alias("pct")), 8)


@query("qcut_bins", SQL + "SELECT sample, tx, CASE WHEN n = 1 THEN 0 ELSE greatest(0, CAST(ceil((r - 1) * 5 / (n - 1)) AS INT) - 1) END AS bin FROM (SELECT sample, tx, row_number() OVER (PARTITION BY sample ORDER BY counts, tx) AS r, count(*) OVER (PARTITION BY sample) AS n FROM cnt)")
def qcut_bins(spark, sf):
    return expression(spark, sf).select("sample", "tx", cohort.quantile_bin("counts", "sample", "tx").alias("bin"))


_Z = lambda x: f"(({x}) - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0)"


@query("zscore_integrative_index", SQL + f"SELECT protein_id, round({_Z('p1')}, 6) AS z_p1, round({_Z('kd')}, 6) AS z_kd, round(({_Z('p1')} + {_Z('kd')} + {_Z('p2')} - {_Z('abs(p2 - 0.4)')} - {_Z('abs(kd - 7)')}) / 5, 6) AS integrative_index FROM prot")
def zscore_index(spark, sf):
    rows = proteins(spark, sf).select("protein_id", F.col("p1").alias("beta_propensity"), F.col("kd").alias("KD_max"), F.col("p2").alias("aromaticity"), (F.col("p2") - 0.4).alias("charge_density"), F.col("kd").alias("pI"))
    out = cohort.integrative_index(rows)
    return rounded(out.select("protein_id", F.col("z_beta_propensity").alias("z_p1"), F.col("z_KD_max").alias("z_kd"), "integrative_index"))


@query("signature_scores", SQL + ", g AS (SELECT sample, gene, sum(counts) AS tpm FROM cnt JOIN tx USING (tx) GROUP BY 1, 2), z AS (SELECT *, (tpm - avg(tpm) OVER (PARTITION BY gene)) / nullif(stddev_pop(tpm) OVER (PARTITION BY gene), 0) AS z, (rank() OVER (PARTITION BY sample ORDER BY tpm) + (count(*) OVER (PARTITION BY sample, tpm) - 1) / 2 - 1) / nullif(count(*) OVER (PARTITION BY sample) - 1, 0) AS pct FROM g) SELECT sample, 'set' || substr(gene, length(gene), 1) AS signature, round(avg(z), 5) AS mean_z, round(avg(pct), 5) AS rank_score, count(*) AS n_genes FROM z GROUP BY 1, 2")
def signature_scores(spark, sf):
    g = expression(spark, sf).join(transcripts(spark, sf), "tx").groupBy("sample", "gene").agg(F.sum("counts").alias("tpm"))
    members = transcripts(spark, sf).select("gene", F.concat(F.lit("set"), F.expr("right(gene, 1)")).alias("signature")).distinct()
    return rounded(cohort.signature_scores(g, members), 5)


@query("value_counts_missing", "SELECT coalesce(lang, 'Missing') AS lang, coalesce(quality::VARCHAR, 'Missing') AS quality, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY coalesce(lang, 'Missing')) AS fraction FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def value_counts(spark, sf):
    from pyspark.sql import Window

    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").groupBy(F.coalesce("lang", F.lit("Missing")).alias("lang"), F.coalesce(F.col("quality").cast("string"), F.lit("Missing")).alias("quality")).agg(F.count("*").alias("n"))
    return rows.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))


@query("crosstab", SQL + "SELECT sample, count(*) FILTER (l1 = 'Amyloid') AS pos, count(*) FILTER (l1 = 'Non-Amyloid') AS neg FROM pred GROUP BY 1")
def crosstab(spark, sf):
    wide = predicted(spark, sf).groupBy("sample").pivot("l1", ["Amyloid", "Non-Amyloid"]).agg(F.count(F.lit(1)))
    return wide.select("sample", F.coalesce("Amyloid", F.lit(0)).alias("pos"), F.coalesce("Non-Amyloid", F.lit(0)).alias("neg"))


@query("overlap_counts", SQL + "SELECT count(*) FILTER (l1 = 'Amyloid' AND l2 = 'Amyloid') AS both_pos, count(*) FILTER (l1 = 'Amyloid' AND l2 <> 'Amyloid') AS only_a, count(*) FILTER (l1 <> 'Amyloid' AND l2 = 'Amyloid') AS only_b, count(*) FILTER (abs(p1 - 0.5) <= 0.01 OR abs(p2 - 0.5) <= 0.01) AS near FROM pred")
def overlap_counts(spark, sf):
    from ..operators.scoring import near_threshold

    a, b = F.col("l1") == "Amyloid", F.col("l2") == "Amyloid"
    return predicted(spark, sf).agg(F.count_if(a & b).alias("both_pos"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(near_threshold(F.col("p1"), F.col("p2"))).alias("near"))


@query("unpivot_long", SQL + "SELECT protein_id, 'p1' AS metric, p1 AS value FROM prot UNION ALL SELECT protein_id, 'p2', p2 FROM prot")
def unpivot_long(spark, sf):
    return proteins(spark, sf).unpivot("protein_id", ["p1", "p2"], "metric", "value")


@query("coverage_qc", SQL + "SELECT sample, round(sum(tpm) FILTER (tx IN (SELECT tx FROM prot WHERE p1 > 0.5)) / nullif(sum(tpm), 0), 6) AS coverage FROM expr JOIN (SELECT tx FROM tx WHERE biotype = 'protein_coding') USING (tx) GROUP BY 1")
def coverage_qc(spark, sf):
    coding = expression(spark, sf).join(transcripts(spark, sf).where("biotype = 'protein_coding'").select("tx"), "tx")
    known = proteins(spark, sf).where("p1 > 0.5").select("tx", F.lit(True).alias("k")).distinct()
    rows = coding.join(known, "tx", "left")
    return rounded(rows.groupBy("sample").agg(cohort.share(F.sum(F.when(F.col("k"), F.col("tpm"))), F.sum("tpm")).alias("coverage")))


@query("cross_panel_presence", SQL + ", panel AS (SELECT tx FROM tx WHERE len <= 5), grid AS (SELECT sample, tx FROM samples CROSS JOIN panel) SELECT grp, tx, avg(CASE WHEN counts > 0 THEN 1.0 ELSE 0 END)::DOUBLE AS presence FROM grid JOIN samples USING (sample) LEFT JOIN cnt USING (sample, tx) GROUP BY 1, 2")
def cross_panel(spark, sf):
    """Every group with every transcript of the panel: the groups and their sizes (a few rows) ride along as one array,
    and only samples that express a transcript are counted, so no pair of a sample and a transcript is made."""
    sizes = samples(spark, sf).groupBy("grp").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("grp", "n")).alias("groups"))
    grid = transcripts(spark, sf).where("len <= 5").select("tx").join(F.broadcast(sizes)).select("tx", F.explode("groups").alias("g")).select("tx", "g.grp", "g.n")
    on = expression(spark, sf).where("counts > 0").select("sample", "tx").join(samples(spark, sf).select("sample", "grp"), "sample").groupBy("grp", "tx").agg(F.count("*").alias("k"))
    return grid.join(on, ["grp", "tx"], "left").select("grp", "tx", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("presence"))


@query("id_intersect", SQL + "SELECT tx FROM prot WHERE p1 > 0.8 INTERSECT SELECT tx FROM prot WHERE p2 > 0.8")
def id_intersect(spark, sf):
    p = proteins(spark, sf)
    return p.where("p1 > 0.8").select("tx").intersect(p.where("p2 > 0.8").select("tx"))


@query("id_except", SQL + "SELECT tx FROM tx EXCEPT SELECT tx FROM prot WHERE p1 > 0.9")
def id_except(spark, sf):
    return transcripts(spark, sf).select("tx").join(proteins(spark, sf).where("p1 > 0.9").select("tx").distinct(), "tx", "left_anti")


@query("quantile_thresholds", SQL + "SELECT round(quantile_cont(p1, 0.17), 6) AS q17, round(quantile_cont(p1, 0.83), 6) AS q83, round(avg(p1), 6) AS mean, round(stddev_samp(p1), 6) AS sd, round(median(p1), 6) AS med FROM prot")
def quantile_thresholds(spark, sf):
    """The two cuts and the median are selected by counts of ever narrower steps; no task sees all values."""
    rows = proteins(spark, sf)
    cut = ordered.select_quantiles(rows, "p1", {"q17": 0.17, "q83": 0.83, "med": 0.5})
    return rounded(rows.agg(*(F.lit(cut[k]).cast("double").alias(k) for k in ("q17", "q83")), F.avg("p1").alias("mean"), F.stddev_samp("p1").alias("sd"), F.lit(cut["med"]).cast("double").alias("med")))


_PCT = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query("describe_scores", SQL + "SELECT sample, count(p1) AS n, round(avg(p1), 6) AS mean, round(stddev_samp(p1), 6) AS sd, min(p1) AS min, " + ", ".join(f"round(quantile_cont(p1, {k / 100}), 6) AS p{k:02d}" for k in _PCT) + ", max(p1) AS max FROM prot GROUP BY 1")
def describe_scores(spark, sf):
    return rounded(cohort.describe(proteins(spark, sf), "p1", ["sample"]))


@query("predictor_counts", SQL + "SELECT predictor, biotype, prediction, count(*) AS n FROM (SELECT 'a' AS predictor, biotype, l1 AS prediction FROM pred LEFT JOIN tx USING (tx) UNION ALL SELECT 'b', biotype, l2 FROM pred LEFT JOIN tx USING (tx)) GROUP BY 1, 2, 3")
def predictor_counts(spark, sf):
    rows = predicted(spark, sf).join(transcripts(spark, sf).select("tx", "biotype"), "tx", "left")
    return cohort.stacked_counts(rows.select("biotype", F.col("l1").alias("a"), F.col("l2").alias("b")), ["a", "b"], ["biotype"])


@query("burden_metrics", _COLLAPSED + ", kd AS (SELECT sample, tx, max(kd) AS kd_max FROM prot GROUP BY 1, 2), b AS (SELECT sample, tpm, score, positive, kd_max FROM joined JOIN kd USING (sample, tx)) SELECT sample, round(sum(tpm) FILTER (positive), 4) AS tpm_burden, round(sum(log2(tpm + 1)) FILTER (positive), 4) AS log2_burden, round(sum(log2(tpm + 1) * kd_max) FILTER (positive), 4) AS hydropathy_burden, round(sum(tpm * score) / nullif(sum(tpm) FILTER (score IS NOT NULL), 0), 6) AS weighted_score FROM b GROUP BY 1")
def burden_metrics(spark, sf):
    kd = proteins(spark, sf).groupBy("sample", "tx").agg(F.max("kd").alias("kd_max"))
    rows = burdened(spark, sf).select("sample", "tx", "tpm", "score", "positive").join(kd, ["sample", "tx"])
    out = cohort.burden_metrics(rows)
    return out.select("sample", *(F.round(c, 4).alias(c) for c in ("tpm_burden", "log2_burden", "hydropathy_burden")), F.round("weighted_score", 6).alias("weighted_score"))


@query("panel_rollup", SQL + "SELECT sample, count(*) AS n_genes, count(*) FILTER (g > 1000) AS n_expressed, round(sum(g), 4) AS total, round(avg(g), 4) AS mean, round(max(g), 4) AS most FROM (SELECT sample, gene, sum(tpm) AS g FROM expr JOIN tx USING (tx) GROUP BY 1, 2) GROUP BY 1")
def panel_rollup(spark, sf):
    rows = expression(spark, sf).join(transcripts(spark, sf), "tx")
    return rounded(cohort.panel_rollup(rows, "gene", "tpm", least=1000), 4)


@query("signature_coverage", SQL + ", s AS (SELECT DISTINCT 'set' || substr(gene, length(gene), 1) AS signature, gene FROM tx), u AS (SELECT DISTINCT gene FROM expr JOIN tx USING (tx) WHERE tpm > 3000) SELECT signature, count(*) AS n_genes, count(u.gene) AS n_present, coalesce(string_agg(s.gene, ',' ORDER BY s.gene) FILTER (u.gene IS NOT NULL), '') AS present, coalesce(string_agg(s.gene, ',' ORDER BY s.gene) FILTER (u.gene IS NULL), '') AS missing FROM s LEFT JOIN u USING (gene) GROUP BY 1")
def signature_coverage(spark, sf):
    tx = transcripts(spark, sf)
    members = tx.select(F.concat(F.lit("set"), F.expr("right(gene, 1)")).alias("signature"), "gene").distinct()
    found = expression(spark, sf).where("tpm > 3000").join(tx, "tx").select("gene")
    return cohort.signature_coverage(members, found)


@query("pair_summary", SQL + ", pairs AS (SELECT sample, p1 - p2 AS shift, kd AS distance FROM prot WHERE tx % 4 = 0 AND sample % 5 <> 0) SELECT sample, count(shift) AS n_pairs, round(avg(shift), 6) AS mean_shift, round(median(shift), 6) AS median_shift, round(avg(CASE WHEN shift IS NOT NULL THEN (shift > 0)::INT END), 6) AS fraction_up, round(avg(distance), 6) AS mean_distance, round(median(distance), 6) AS median_distance FROM samples LEFT JOIN pairs USING (sample) GROUP BY 1")
def pair_summary(spark, sf):
    pairs = proteins(spark, sf).where("tx % 4 = 0 and sample % 5 <> 0").select("sample", (F.col("p1") - F.col("p2")).alias("shift"), F.col("kd").alias("distance"))
    return rounded(cohort.pair_summary(pairs, samples(spark, sf).select("sample")))


@query("keyword_flags", "SELECT p_partkey, contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') AS metal, contains(lower(p_type), 'plated') AS plated FROM part")
def keyword_flags(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("where"))
    return rows.select("p_partkey", *(e.alias(k) for k, e in labels.keyword_flags(["where"], {"metal": ("Steel", "tin"), "plated": ("PLATED",)}).items()))


@query("stability_summary", SQL + "SELECT grp, count(*) AS n, count(*) FILTER (age > 0) AS n_true, min(age) AS min, round(median(age), 6) AS median, max(age) AS max FROM samples GROUP BY 1")
def stability_summary(spark, sf):
    return rounded(cohort.stability(samples(spark, sf).withColumn("up", F.col("age") > 0), ["grp"], "up", "age"))


@query("first_known", "SELECT o_custkey, arg_min(nullif(o_orderpriority, '3-MEDIUM'), o_orderkey) FILTER (o_orderpriority <> '3-MEDIUM') AS first FROM orders GROUP BY 1")
def first_known(spark, sf):
    o = read(spark, sf, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("3-MEDIUM")))
    return o.groupBy("o_custkey").agg(cohort.first_known("p", "o_orderkey").alias("first"))


@query("ordered_samples", "SELECT s_suppkey, rank() OVER (ORDER BY o, s_acctbal DESC, s_suppkey) AS place FROM supplier JOIN (VALUES (2, 0), (0, 1), (1, 2)) v(k, o) ON s_nationkey % 3 = k")
def ordered_samples(spark, sf):
    """Rows in the order of a list of categories, then of a number: a wide rank by sorted ranges, no one-task window."""
    rows = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).cast("string").alias("k"), "s_acctbal")
    return cohort.numbered(rows, [cohort.by_list("k", ["2", "0", "1"]), F.desc("s_acctbal"), F.asc("s_suppkey")], "place").select("s_suppkey", "place")


@query("matched_controls")
def matched_controls(spark, sf):
    rows = predicted(spark, sf).withColumn("hot", F.col("consensus") == "Amyloid").join(transcripts(spark, sf).select("tx", "biotype"), "tx", "left")
    return cohort.match_controls(rows, "sample", "hot", ["kd"], ["p2", "kd"], "protein_id", ["biotype"])


@query("downsample_per_class")
def downsample(spark, sf):
    return cohort.sample_per_class(predicted(spark, sf).select("protein_id", "consensus"), "consensus", 50, "protein_id")
