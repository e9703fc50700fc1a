"""The driver's tables in the roles of cohort tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    s, n = read(spark, sf, "supplier"), read(spark, sf, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("subject"), F.when(F.col("s_acctbal") > 0, "BC").otherwise("V2").alias("time"), F.when(F.col("n_regionkey") % 2 == 0, "AC").otherwise("TOL").alias("grp"), F.col("s_acctbal").alias("age"))


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("tx"), F.col("p_brand").alias("gene"), F.when(F.col("p_size") % 3 != 0, "protein_coding").otherwise("lncRNA").alias("biotype"), F.col("p_size").alias("len"))


def proteins(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("tx"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("protein_id"), F.round(F.col("l_discount") * 10, 6).alias("p1"), F.round(F.col("l_tax") * 12.5, 6).alias("p2"), F.round(F.col("l_extendedprice") / 1000, 6).alias("kd"))


def expression(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("tx")).agg(F.sum("l_quantity").alias("counts"))
    return cohort.tpm(rows)


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text")


SQL = """WITH samples AS (SELECT s_suppkey AS sample, s_nationkey AS subject, CASE WHEN s_acctbal > 0 THEN 'BC' ELSE 'V2' END AS "time", CASE WHEN n_regionkey % 2 = 0 THEN 'AC' ELSE 'TOL' END AS grp, s_acctbal AS age FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tx AS (SELECT p_partkey AS tx, p_brand AS gene, CASE WHEN p_size % 3 <> 0 THEN 'protein_coding' ELSE 'lncRNA' END AS biotype, p_size AS len FROM part),
prot AS (SELECT l_suppkey AS sample, l_partkey AS tx, l_orderkey * 10 + l_linenumber AS protein_id, round(l_discount * 10, 6) AS p1, round(l_tax * 12.5, 6) AS p2, round(l_extendedprice / 1000, 6) AS kd FROM lineitem),
cnt AS (SELECT l_suppkey AS sample, l_partkey AS tx, sum(l_quantity) AS counts FROM lineitem GROUP BY 1, 2),
expr AS (SELECT *, counts * 1e6 / sum(counts) OVER (PARTITION BY sample) AS tpm FROM cnt),
pred AS (SELECT *, CASE WHEN p1 > 0.5 THEN 'Amyloid' ELSE 'Non-Amyloid' END AS l1, CASE WHEN p2 > 0.5 THEN 'Amyloid' ELSE 'Non-Amyloid' END AS l2 FROM prot)
"""
#: Cleaned sequences (doc_id, s); the sharp s is the one letter whose upper case is ASCII.
SEQ = "WITH seq AS (SELECT doc_id, regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM documents)\n"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places: sums in another order differ in the last bits."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
