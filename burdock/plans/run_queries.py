"""Runs over a sample sheet: the stand-in tables are written as one sample's files each, and the whole sheet is run."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import runs
from ..sources import models, shared, writers
from .registry import query
from .sequence_queries import _DNA
from .source_queries import _pick, _protein, _text
from .standins import read

_TAKEN = "n_nationkey NOT IN (23, 24)"
_RUN = f"""WITH d AS (SELECT doc_id, dna, length(dna) AS n, length(dna) // 3 AS h, doc_id % 3 = 0 AS back FROM (SELECT doc_id, {_DNA} AS dna FROM documents WHERE text IS NOT NULL) WHERE length(dna) >= 6),
ids AS (SELECT n_nationkey AS k, doc_id FROM d, nation WHERE {_TAKEN} AND (doc_id * 7 + n_nationkey * 13) % 11 > 4 AND n - h >= 10),
v0 AS (SELECT o_custkey % 25 AS k, doc_id, (o_orderkey * 7919) % n + 1 AS pos, o_custkey % 3 <> 0 AS exchanged, o_orderkey % 3 AS g, dna, h FROM orders JOIN d ON doc_id = (o_orderkey // 4) % (SELECT count(*) FROM documents)),
v AS (SELECT v0.* FROM v0 JOIN ids USING (k, doc_id) WHERE pos <= h OR pos > 2 * h),
hap AS (SELECT k, doc_id, pos, translate(substr(dna, pos::INT, 1), 'ACGT', 'CGTA') AS alt, unnest(CASE g WHEN 0 THEN [2] WHEN 1 THEN [1] ELSE [1, 2] END) AS hap FROM v WHERE exchanged),
e AS (SELECT k, doc_id, hap, map_from_entries(list((pos, alt))) AS m FROM (SELECT DISTINCT * FROM hap) GROUP BY ALL),
p AS (SELECT k, doc_id, back, h, n, CASE WHEN m IS NULL THEN dna ELSE list_aggregate(list_transform(range(1, n + 1), lambda i: coalesce(m[i], substr(dna, i::INT, 1))), 'string_agg', '') END AS s FROM ids JOIN d USING (doc_id) CROSS JOIN (VALUES (1), (2)) x(hap) LEFT JOIN e USING (k, doc_id, hap)),
f AS (SELECT k, doc_id, CASE WHEN pos <= h THEN substr(dna, 1, pos::INT) || 'G' || substr(dna, pos::INT + 1, (h - pos)::INT) || substr(dna, 2 * h + 1) ELSE substr(dna, 1, h) || substr(dna, 2 * h + 1, (pos - 2 * h)::INT) || 'G' || substr(dna, pos::INT + 1) END AS c FROM v WHERE NOT exchanged),
c AS (SELECT k, doc_id, 'p' AS kind, substr(s, 1, h) || substr(s, 2 * h + 1) AS c FROM p UNION ALL SELECT k, doc_id, 'f', c FROM f),
t AS (SELECT k, doc_id, kind, CASE WHEN doc_id % 3 = 0 THEN reverse(translate(c, 'ACGT', 'TGCA')) ELSE c END AS c FROM c),
u AS (SELECT c, {_protein("c")} AS protein FROM (SELECT DISTINCT c FROM t)),
a AS (SELECT k, kind, protein FROM t JOIN u USING (c) WHERE kind = 'p' AND protein <> '' UNION ALL SELECT DISTINCT k, kind, protein FROM (SELECT DISTINCT k, kind, doc_id % 100 AS gene, protein FROM t JOIN u USING (c) WHERE kind = 'f' AND length(protein) >= 6)),
fs AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, doc_id % 100 AS gene, protein FROM t JOIN u USING (c) WHERE kind = 'f' AND length(protein) >= 6) GROUP BY 1),
pr AS (SELECT k, count(*) AS n, sum(length(protein)) AS residues, sum(('0x' || substr(md5(protein), 1, 8))::BIGINT) AS checksum FROM a WHERE kind = 'p' GROUP BY 1),
ni AS (SELECT k, count(*) AS n FROM ids GROUP BY 1)
SELECT 'N' || n_nationkey AS sample, CASE WHEN {_TAKEN} THEN 'OK' ELSE 'SKIP' END AS status, coalesce(ni.n, 0)::BIGINT AS n_ids, coalesce(pr.n, 0)::BIGINT AS n_proteins, coalesce(fs.n, 0)::BIGINT AS n_frameshifts, (coalesce(pr.n, 0) + coalesce(fs.n, 0))::BIGINT AS n_combined, coalesce(pr.residues, 0)::BIGINT AS residues, coalesce(pr.checksum, 0)::BIGINT AS checksum
FROM nation LEFT JOIN ni ON ni.k = n_nationkey LEFT JOIN pr ON pr.k = n_nationkey LEFT JOIN fs ON fs.k = n_nationkey"""


def _files(spark, sf) -> dict[str, str]:
    """A sheet of one sample a nation: every document is a chromosome with one transcript of two exons, every order a
    variant of a sample. The last nation has no variant calls, the one before it no abundances."""
    at = shared.folder(spark)
    k, letters = F.col("doc_id"), F.regexp_replace(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), "[^A-Z]", "")
    docs = read(spark, sf, "documents").where("text is not null").select(k, F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC").alias("dna"))
    docs.write.parquet(f"{at}/docs")  # cleaned once, not anew for each kind of file
    docs = spark.read.parquet(f"{at}/docs").withColumns({"n": F.length("dna"), "h": F.floor(F.length("dna") / 3).cast("int")}).where("n >= 6")
    writers.fasta(docs.select(_text("c", k).alias("header"), F.col("dna").alias("sequence"), k.alias("ord")), f"{at}/g.fa")
    strand = F.when(k % 3 == 0, "-").otherwise("+")
    stretches = F.explode(F.array(F.struct(F.lit(1).alias("a"), F.col("h").alias("b")), F.struct((2 * F.col("h") + 1).alias("a"), F.col("n").alias("b"))))
    features = docs.select(k, strand.alias("strand"), stretches.alias("x")).withColumn("f", F.explode(F.array(F.lit("exon"), F.lit("CDS"))))
    features.select(_text("c", k, "\tx\t", F.col("f"), "\t", F.col("x.a"), "\t", F.col("x.b"), "\t.\t", F.col("strand"), '\t.\tgene_id "G', k % 100, '"; transcript_id "ENST', k, '.1";')).write.text(f"{at}/a.gtf")
    who = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    tpm = docs.select(k).join(F.broadcast(who)).select(_text("ENST", F.col("doc_id"), ".1|g").alias("target_id"), *(F.lit(1.0).alias(c) for c in ("length", "eff_length", "est_counts")), (((F.col("doc_id") * 7 + F.col("k") * 13) % 11) / 4.0).alias("tpm"), _text("N", F.col("k")).alias("who"))
    tpm.write.partitionBy("who").csv(f"{at}/abundance", sep="\t", header=True)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    n_docs = read(spark, sf, "documents").agg(F.count("*").alias("n_docs"))
    orders = read(spark, sf, "orders").join(F.broadcast(n_docs)).withColumn("doc_id", F.floor(o / 4) % F.col("n_docs"))
    placed = orders.join(docs, "doc_id").withColumn("pos", (o * 7919) % F.col("n") + 1).withColumn("ref", F.expr("substring(dna, cast(pos as int), 1)"))
    alt = F.when(c % 3 != 0, F.translate("ref", "ACGT", "CGTA")).otherwise(F.concat("ref", F.lit("G")))
    line = _text("c", F.col("doc_id"), "\t", F.col("pos"), "\t.\t", F.col("ref"), "\t", alt, "\t50\tPASS\t.\tGT\t", _pick(["0|1", "1|0", "1/1"], o % 3))
    placed.select(line, _text("N", c % 25).alias("who")).write.partitionBy("who").text(f"{at}/vcf")
    table = [round(i / 46655, 6) for i in range(46656)]
    models.write_bytes(spark, f"{at}/table.json", json.dumps(table).encode())
    path = lambda folder, lacks: F.when(F.col("k") != lacks, _text(f"{at}/{folder}/who=N", F.col("k"))).otherwise("")
    writers.table(who.select(_text("N", F.col("k")).alias("sample_id"), path("abundance", 23).alias("abundance"), path("vcf", 24).alias("vcf")), f"{at}/samples.csv", ",")
    return {"outdir": f"{at}/out", "samples": f"{at}/samples.csv", "ref_genome": f"{at}/g.fa", "ref_gtf": f"{at}/a.gtf", "sixmer_table": f"{at}/table.json"}


@query("prepared_run", _RUN)
def prepared_run(spark, sf):
    """Every sample's states and proteins, as counted and as a sum of digests; all predictions are made on the way."""
    out = runs.run(spark, runs.Parameters("prepared", run_protein_features=False, **_files(spark, sf)))
    own = out["proteins"].groupBy("sample").agg(F.sum(F.length("sequence")).alias("residues"), F.sum(F.conv(F.substring(F.md5("sequence"), 1, 8), 16, 10).cast("long")).alias("checksum"))
    named = {"clean_ids": "n_ids", "proteins": "n_proteins", "frameshifts": "n_frameshifts", "combined": "n_combined"}
    states = out["states"].groupBy("sample").agg(F.max(F.when(F.col("step") == "combined", F.col("status"))).alias("status"), *(F.max(F.when(F.col("step") == s, F.col("n"))).alias(c) for s, c in named.items()))
    zero = F.lit(0).cast("long")
    return states.join(own, "sample", "left").select("sample", "status", *named.values(), F.coalesce("residues", zero).alias("residues"), F.coalesce("checksum", zero).alias("checksum"))
