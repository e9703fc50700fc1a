"""Proteome construction and caller consensus over stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import proteome, variants
from .registry import query
from .standins import SQL, expression, proteins, read, samples, transcripts


@query("clean_ids", SQL + "SELECT 'T' || tx || '.1' AS id FROM tx WHERE len >= 10 AND len % 5 <> 0 AND tx IN (SELECT tx FROM expr WHERE tpm > 2000) AND tx % 4 <> 0")
def clean_ids(spark, sf):
    """Expressed under the full or the version-free id, long enough, with an exon, and on the list."""
    name = F.concat(F.lit("T"), F.col("tx").cast("string"))
    tx = transcripts(spark, sf).select(F.concat(name, F.lit(".1")).alias("transcript_id"), name.alias("clean_id"), F.col("len").alias("cds_bp"), F.when(F.col("len") % 5 != 0, F.array(F.col("len"))).otherwise(F.array().cast("array<int>")).alias("exons"), "tx")
    on = expression(spark, sf).select(F.when(F.col("tx") % 2 == 0, name).otherwise(F.concat(name, F.lit(".1"))).alias("transcript_id"), "tpm")
    listed = tx.where("tx % 4 <> 0").select(F.when(F.col("tx") % 3 == 0, F.col("clean_id")).otherwise(F.col("transcript_id")).alias("id"))
    return proteome.expressed_ids(tx.drop("tx"), on, 2000, 10, listed)


@query("interval_join", "WITH p AS (SELECT user_id AS k, event_id, event_id % 5000 AS pos FROM events), s AS (SELECT o_custkey AS k, o_orderkey, o_orderkey % 5000 AS a, o_orderkey % 5000 + o_orderkey % 700 AS b FROM orders) SELECT o_orderkey, count(*) AS n, min(event_id) AS first_event FROM p JOIN s USING (k) WHERE pos BETWEEN a AND b GROUP BY 1")
def interval_join(spark, sf):
    points = read(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id", (F.col("event_id") % 5000).cast("int").alias("pos"))
    at = (F.col("o_orderkey") % 5000).cast("int")
    spans = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", at.alias("a"), (at + F.col("o_orderkey") % 700).cast("int").alias("b"))
    return proteome.range_join(points, spans, "k", "pos", "a", "b", 512).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("combine_dedup_union", "WITH u AS (SELECT 0 AS file_ord, o_orderkey AS ord, o_orderpriority AS id, o_orderstatus AS sequence FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 1, o_orderkey, o_orderpriority, o_orderstatus FROM orders) SELECT id, sequence, file_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY id, sequence ORDER BY file_ord, ord) AS n FROM u) WHERE n = 1")
def combine_union(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("sequence"), F.col("o_orderkey").alias("ord"))
    return proteome.union_distinct(rows.where("sequence <> 'P'"), rows)


@query("nonsense_pivot", "WITH h AS (SELECT p_partkey AS k, p_size AS a, p_size + p_partkey % 40 - 20 AS b FROM part) SELECT k::VARCHAR AS TRANSCRIPT_ID, a AS LEN_H1, greatest(b, 1) AS LEN_H2, '-' || abs(a - greatest(b, 1)) AS LOSS, CASE WHEN a > greatest(b, 1) THEN 'H2_TRUNCATED' ELSE 'H1_TRUNCATED' END AS STATUS FROM h WHERE abs(a - greatest(b, 1)) > 10 AND abs(a - greatest(b, 1))::DOUBLE / greatest(a, b, 1) > 0.05")
def nonsense_pivot(spark, sf):
    part = read(spark, sf, "part")
    rec = lambda h, n: part.select(F.concat(F.lit(f"{h}_"), F.col("p_partkey").cast("string")).alias("id"), F.repeat(F.lit("A"), n.cast("int")).alias("sequence"), F.col("p_partkey").alias("ord"))
    second = F.greatest(F.col("p_size") + F.col("p_partkey") % 40 - 20, F.lit(1))
    return proteome.truncations(rec("H1", F.col("p_size")).unionByName(rec("H2", second)))


_CALLS = "WITH calls AS (SELECT l_suppkey % 9 AS sample, l_returnflag AS caller, ['A', 'B', 'C'][l_linenumber % 3 + 1] AS locus, 'HLA-' || ['A', 'B', 'C'][l_linenumber % 3 + 1] || '*0' || (l_partkey % 5) || ':01' AS allele, l_linenumber AS rank, l_linestatus AS source_file FROM lineitem)"
_CONSENSUS = """, a AS (SELECT sample, locus, allele, count(DISTINCT caller) AS support_count, min(rank) AS r, string_agg(DISTINCT caller, ',' ORDER BY caller) AS support_callers, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS source_files FROM calls GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY sample, locus ORDER BY support_count DESC, r, allele) AS n FROM a),
s AS (SELECT *, max(support_count) OVER (PARTITION BY sample, locus) >= 2 AS backed FROM t WHERE n <= 2),
c AS (SELECT sample, locus, count(DISTINCT caller) AS caller_count FROM calls GROUP BY 1, 2)
SELECT sample, locus, allele, CASE WHEN support_count >= 2 THEN 'CONSENSUS' WHEN caller_count <= 1 THEN 'SINGLE_CALLER' WHEN backed THEN 'LOW_SUPPORT' ELSE 'CONFLICT' END AS consensus_status, support_count, support_callers, caller_count, source_files FROM s JOIN c USING (sample, locus)"""
_RANKS = " SELECT sample, caller, locus, allele, rank() OVER (PARTITION BY sample, caller, locus ORDER BY m, allele) AS rank FROM (SELECT sample, caller, locus, allele, min(rank) AS m FROM calls GROUP BY 1, 2, 3, 4)"


def _calls(lines):
    locus = F.element_at(F.array(*map(F.lit, "ABC")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return lines.select((F.col("l_suppkey") % 9).alias("sample"), F.col("l_returnflag").alias("caller"), locus.alias("locus"), F.concat(F.lit("HLA-"), locus, F.lit("*0"), (F.col("l_partkey") % 5).cast("string"), F.lit(":01")).alias("allele"), F.col("l_linenumber").alias("rank"), F.col("l_linestatus").alias("source_file"))


def _ranked(calls):
    return proteome.hla_ranks(calls.withColumnRenamed("rank", "ord")).select("sample", "caller", "locus", "allele", "rank")


@query("hla_consensus", _CALLS + _CONSENSUS)
def hla_consensus(spark, sf):
    return proteome.hla_consensus(_calls(read(spark, sf, "lineitem")))


@query("hla_ranks", _CALLS + _RANKS)
def hla_ranks(spark, sf):
    return _ranked(_calls(read(spark, sf, "lineitem")))


_TYPED = _CALLS + ", typed AS (SELECT c.sample, CASE WHEN c.sample % 2 = 0 THEN 'AC' ELSE 'TOL' END AS grp, locus, allele FROM calls c)"


@query("allele_group_counts", _TYPED + " SELECT grp, locus, allele, count(DISTINCT sample) AS n_samples FROM typed GROUP BY 1, 2, 3")
def allele_group_counts(spark, sf):
    calls = _calls(read(spark, sf, "lineitem"))
    grp = calls.select("sample").distinct().withColumn("grp", F.when(F.col("sample") % 2 == 0, "AC").otherwise("TOL"))
    return proteome.allele_counts(calls, grp)


@query("truncation_counts", SQL + "SELECT sample, grp, count(tx) AS n_rows, count(DISTINCT split_part('T' || (tx % 50) || '.' || tx, '.', 1)) FILTER (tx IS NOT NULL) AS n_transcripts FROM samples LEFT JOIN (SELECT sample, tx FROM prot WHERE p1 > 0.9 AND sample % 3 <> 0) USING (sample) GROUP BY 1, 2")
def truncation_counts(spark, sf):
    """Samples without a truncation have zeros."""
    rows = proteins(spark, sf).where("p1 > 0.9 and sample % 3 <> 0").select("sample", F.concat(F.lit("T"), (F.col("tx") % 50).cast("string"), F.lit("."), F.col("tx").cast("string")).alias("TRANSCRIPT_ID"))
    return proteome.truncation_counts(rows, samples(spark, sf).select("sample", "grp"))


@query("variant_filters", "WITH v AS (SELECT event_id, user_id % 20 AS chrom, event_id % 20000 AS pos, value / 2 AS fs, value % 7 AS qd FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 34 PRECEDING AND CURRENT ROW) AS back FROM v), m AS (SELECT *, max(back) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 34 FOLLOWING) AS most FROM c) SELECT event_id, concat_ws(';', CASE WHEN most >= 3 THEN 'SnpCluster' END, CASE WHEN fs > 30 THEN 'FS' END, CASE WHEN qd < 2 THEN 'QD' END) AS marks FROM m")
def variant_filters(spark, sf):
    info = F.concat(F.lit("AC=1;FS="), (F.col("value") / 2).cast("string"), F.lit(";QD="), (F.col("value") % 7).cast("string"))
    rows = read(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("chrom"), (F.col("event_id") % 20000).alias("pos"), info.alias("info"))
    marked = variants.hard_filters(rows)
    return marked.select("event_id", F.when(F.col("filter") == "PASS", "").otherwise(F.col("filter")).alias("marks"))


@query("reconcile", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.v = b.v THEN 'shared' ELSE 'mismatched' END AS state FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 4 <> 0) b ON a.k = b.k")
def reconcile(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return proteome.reconcile(c.where("k % 3 <> 0"), c.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("v"))), "k", "v")


@query("frameshift_predicate", "SELECT o_orderkey, (length(o_orderpriority) - length(o_orderstatus)) % 3 <> 0 AS shift FROM orders WHERE (length(o_orderpriority) - length(o_orderstatus)) % 3 <> 0")
def frameshift_predicate(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("ref"), F.col("o_orderpriority").alias("alt"))
    return proteome.frameshift_variants(rows).select("o_orderkey", F.lit(True).alias("shift"))


@query("verify_outputs", "WITH n AS (SELECT (SELECT count(*) FROM part) AS ids, (SELECT count(*) FROM orders) AS protein, (SELECT count(*) FROM customer) AS frameshift, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS combined) SELECT unnest(['exists:clean_ids', 'nonempty:clean_ids', 'content:clean_ids', 'exists:protein', 'nonempty:protein', 'content:protein', 'exists:frameshift', 'nonempty:frameshift', 'content:frameshift', 'exists:combined', 'nonempty:combined', 'content:combined', 'exists:nonsense', 'consistency:combined_contains_protein', 'consistency:combined_contains_frameshift']) AS check, unnest(['OK', 'OK', 'OK', 'OK', 'OK', 'OK', 'OK', 'OK', 'OK', 'OK', 'OK', 'OK', 'ATTENTION', CASE WHEN combined >= protein THEN 'OK' ELSE 'ATTENTION' END, CASE WHEN combined >= frameshift THEN 'OK' ELSE 'ATTENTION' END]) AS status FROM n")
def verify_outputs(spark, sf):
    o = read(spark, sf, "orders")
    named = lambda df, k: df.select(F.col(k).cast("string").alias("id"))
    outputs = {"clean_ids": named(read(spark, sf, "part"), "p_partkey"), "protein": named(o, "o_orderkey"), "frameshift": named(read(spark, sf, "customer"), "c_custkey"), "combined": named(o.where("o_orderstatus <> 'P'"), "o_orderkey"), "nonsense": None}
    return proteome.verify_outputs(spark, outputs).select("check", "status")


@query("verification", "SELECT 'orders' AS check, 'OK' AS status, count(*) || ' rows, 0 empty' AS message FROM orders UNION ALL SELECT 'none', 'ATTENTION', '0 rows, 0 empty'")
def verification(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return proteome.verify({"orders": o, "none": o.where("o_orderkey < 0")})
