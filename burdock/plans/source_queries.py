"""Readers and writers: stand-in tables are written as the files a run meets, whole, and read again."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import labels, sequence
from ..operators import cohort, proteome
from ..sources import arrays, models, readers, shared, writers
from .proteome_queries import _CALLS, _calls
from .registry import query
from .sequence_queries import _CODONS, _DNA
from .standins import SEQ, SQL, expression, read, sequences


def _lines(rows, path, head=(), **options):
    """Text files of ``rows`` (value), with the lines of ``head`` in a file of their own."""
    if head:
        rows.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.text(path, **options)
    rows.write.mode("append").text(path, **options)
    return path


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("value")


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


# annotations, variants, abundances

_GTF = """WITH g AS (SELECT ['chr1', 'chr2', 'MT'][l_orderkey % 3 + 1] AS seqname, ['exon', 'CDS', 'transcript', 'gene'][l_linenumber % 4 + 1] AS feature, (l_partkey % 9000 + 1)::INT AS start, (l_partkey % 9000 + 1 + l_suppkey % 300)::INT AS "end", CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN l_linenumber <> 7 THEN 'ENST' || l_orderkey || '.' || (l_orderkey % 4 + 1) END AS transcript_id, 'G' || (l_orderkey % 50) || '.1' AS gene_id, 'N' || (l_orderkey % 50) AS gene_name, CASE WHEN l_orderkey % 5 <> 0 THEN 'protein_coding' END AS biotype FROM lineitem)
"""


def _gtf(spark, sf):
    """Every line item as a line: rows of mitochondrial contigs, rows without a transcript, an attribute whose name ends like another's."""
    o, k = F.col("l_orderkey"), F.col("l_linenumber")
    start = F.col("l_partkey") % 9000 + 1
    transcript = F.when(k != 7, _text('transcript_id "ENST', o, ".", o % 4 + 1, '"; ')).otherwise("")
    biotype = F.when(o % 5 != 0, 'transcript_type "protein_coding"; ').otherwise("")
    line = _text(_pick(["chr1", "chr2", "MT"], o % 3), "\tx\t", _pick(["exon", "CDS", "transcript", "gene"], k % 4), "\t", start, "\t", start + F.col("l_suppkey") % 300, "\t.\t", F.when(o % 2 == 0, "+").otherwise("-"), "\t.\t", 'gene_id "G', o % 50, '.1"; ', transcript, biotype, 'gene_name "N', o % 50, '"; havana_gene_id "H";')
    return _lines(read(spark, sf, "lineitem").select(line), shared.folder(spark) + "/a.gtf", ["##description: stand-in"])


@query("gtf_scan", _GTF + "SELECT seqname, feature, start, \"end\", strand, transcript_id, gene_id FROM g WHERE feature IN ('exon', 'CDS') AND seqname <> 'MT'")
def gtf_scan(spark, sf):
    rows = readers.gtf(spark, _gtf(spark, sf))
    return rows.select("seqname", "feature", "start", "end", "strand", readers.attribute("transcript_id").alias("transcript_id"), readers.attribute("gene_id").alias("gene_id"))


@query("transcript_table", _GTF + "SELECT transcript_id, split_part(transcript_id, '.', 1) AS clean_id, min(gene_id) AS gene_id, min(seqname) AS chrom, min(strand) AS strand, count(*) FILTER (feature = 'exon') AS n_exons, min(start) FILTER (feature = 'exon') AS first_start, coalesce(sum(\"end\" - start + 1) FILTER (feature = 'CDS'), 0)::BIGINT AS cds_bp FROM g WHERE feature IN ('exon', 'CDS') AND seqname <> 'MT' AND transcript_id IS NOT NULL GROUP BY 1")
def transcript_table(spark, sf):
    tx = proteome.transcripts(readers.gtf(spark, _gtf(spark, sf)))
    return tx.select("transcript_id", "clean_id", "gene_id", "chrom", "strand", F.size("exons").alias("n_exons"), F.get("exons", F.lit(0))["start"].alias("first_start"), "cds_bp")


@query("transcript_annotation", _GTF + "SELECT split_part(transcript_id, '.', 1) AS transcript, min(gene_id) AS gene_id, min(gene_name) AS gene_name, min(biotype) AS biotype FROM g WHERE feature = 'transcript' GROUP BY 1")
def transcript_annotation(spark, sf):
    return readers.annotation(spark, _gtf(spark, sf))


_VCF = "WITH v AS (SELECT 'chr' || (o_custkey % 5) AS chrom, o_orderkey AS pos, ['a', 'c', 'gt'][o_orderkey % 3 + 1] AS ref, ['A', 'g,TT', 'T,C', NULL][o_custkey % 4 + 1] AS alt FROM orders)\n"


def _variants(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf, "orders").select(_text("chr", c % 5).alias("chrom"), o.alias("pos"), _pick(["a", "c", "gt"], o % 3).alias("ref"), F.element_at(F.array(F.lit("A"), F.lit("g,TT"), F.lit("T,C"), F.lit(None)), (c % 4 + 1).cast("int")).alias("alt"))


@query("vcf_scan", _VCF + "SELECT chrom, pos, upper(ref) AS ref, upper(split_part(alt, ',', 1)) AS alt FROM v WHERE alt IS NOT NULL")
def vcf_scan(spark, sf):
    """Packed by gzip, with headers; a row without an alternative is left out."""
    line = _text(F.col("chrom"), "\t", F.col("pos"), "\t.\t", F.col("ref"), "\t", F.coalesce("alt", F.lit("")), "\t50\tPASS\tAC=1\tGT\t0|1")
    path = _lines(_variants(spark, sf).select(line), shared.folder(spark) + "/v", ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"], compression="gzip")
    return readers.vcf(spark, path).drop("ord")


@query("snp_alleles", _VCF + "SELECT chrom, pos, ref, alt FROM (SELECT chrom, pos, ref, unnest(string_split(alt, ',')) AS alt FROM v) WHERE length(ref) = 1 AND length(alt) = 1")
def snp_alleles(spark, sf):
    return proteome.snps(_variants(spark, sf))


@query("abundance_scan", "SELECT 'ENST' || p_partkey || '.1' AS transcript_id, CASE WHEN p_partkey % 7 <> 0 THEN 'ENSG' || (p_partkey % 50) || '.2' END AS gene_id, CASE WHEN p_partkey % 7 <> 0 THEN 'NAME' || (p_partkey % 50) END AS gene_name, p_size::DOUBLE AS length, p_size + 0.5 AS tpm FROM part WHERE p_partkey % 5 <> 0")
def abundance_scan(spark, sf):
    """Headers of several fields or of one; rows whose TPM is no number are left out."""
    k = F.col("p_partkey")
    target = _text("ENST", k, ".1", F.when(k % 7 != 0, _text("|ENSG", k % 50, ".2|h|h|t|NAME", k % 50, "|")).otherwise(""))
    rows = read(spark, sf, "part").select(target.alias("target_id"), F.col("p_size").alias("length"), F.col("p_size").alias("eff_length"), F.lit(1.0).alias("est_counts"), F.when(k % 5 == 0, "n/a").otherwise((F.col("p_size") + F.lit(0.5)).cast("string")).alias("tpm"))
    path = shared.folder(spark) + "/abundance.tsv"
    writers.table(rows, path)
    return readers.abundance(spark, path).select("transcript_id", "gene_id", "gene_name", "length", "tpm")


# sequences, ids, predictions


@query("fasta_round_trip", SEQ + "SELECT 'D' || doc_id AS id, length(s) AS raw_length, length(s) AS clean_length, CASE WHEN length(s) = 0 THEN 'empty_after_cleaning' WHEN length(s) < 6 THEN 'shorter_than_6' ELSE 'ok' END AS status, md5(s) AS digest FROM seq")
def fasta_round_trip(spark, sf):
    """Whole sequences in lines of 80, read back."""
    rows = sequences(spark, sf).select(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(" stand-in")).alias("header"), sequence.clean(F.coalesce("text", F.lit(""))).alias("sequence"), F.col("doc_id").alias("ord"))
    path = shared.folder(spark) + "/p.fasta"
    writers.fasta(rows, path)
    return readers.classified(readers.fasta(spark, path)).select("id", "raw_length", "clean_length", "status", F.md5("clean").alias("digest"))


@query("id_list_round_trip", "SELECT DISTINCT 'C' || o_custkey AS id FROM orders")
def id_list_round_trip(spark, sf):
    path = shared.folder(spark) + "/ids.txt"
    writers.ids(read(spark, sf, "orders").select(_text("C", F.col("o_custkey"), ".", F.col("o_orderkey") % 3).alias("id")), path)
    return readers.ids(spark, path, strip=True)


@query("predictions_scan", "SELECT c_custkey::VARCHAR AS id, round(c_acctbal::DOUBLE / 7, 4) AS prob, CASE WHEN c_acctbal > 0 THEN 'Amyloid' WHEN c_custkey % 2 = 0 THEN 'NA' ELSE 'Non-Amyloid' END AS pred FROM customer")
def predictions_scan(spark, sf):
    """Headers of another spelling; ten digits of each value; labels brought to one form."""
    k, p = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    rows = read(spark, sf, "customer").select(k.alias("Sequence_ID"), writers.ten_digits(p / 7).alias("Probability"), F.when(p > 0, "amyloidogenic").when(k % 2 != 0, "NON_amyloid").alias("Label"))
    path = shared.folder(spark) + "/p.csv"
    writers.table(rows, path, ",")
    got = readers.predictions(spark, path, {"id": ("id", "Sequence_ID"), "prob": ("Probability",), "pred": ("Prediction", "Label")})
    return got.select("id", F.round(F.col("prob").cast("double"), 4).alias("prob"), labels.normal(F.col("pred")).alias("pred"))


# caller outputs


@query("hla_log_scan", _CALLS + " SELECT l AS locus, a AS allele, count(*) AS n FROM (SELECT unnest([locus, 'DRB1']) AS l, unnest([allele, 'HLA-DRB1*15:01']) AS a FROM calls) GROUP BY 1, 2")
def hla_log_scan(spark, sf):
    """Two alleles a line, among other words."""
    line = _text("round ", F.col("rank"), " best ", F.regexp_replace("allele", "^HLA-", ""), " then HLA_DRB1*15:01; 3*2")
    path = _lines(_calls(read(spark, sf, "lineitem")).select(line), shared.folder(spark) + "/log")
    return readers.hla_log(spark.read.text(path), "s", "log").groupBy("locus", "allele").agg(F.count("*").alias("n"))


@query("hla_json_scan", _CALLS + " SELECT DISTINCT locus, allele FROM calls UNION SELECT 'DRB1', 'HLA-DRB1*15:01'")
def hla_json_scan(spark, sf):
    """One object a line, with alleles in lists and in keys of nested objects."""
    text = _text('{"calls": {"', F.col("locus"), '": ["', F.col("allele"), '", 3]}, "more": {"DRB1*15:01": {"n": 1}}}')
    path = _lines(_calls(read(spark, sf, "lineitem")).select(text), shared.folder(spark) + "/json")
    return readers.hla_json(spark.read.text(path), "s", "json").select("locus", "allele")


@query("normalized_hla_scan", _CALLS + " SELECT sample::VARCHAR AS sample, caller, locus, allele, CASE WHEN rank = 7 THEN 999 ELSE rank END AS rank, source_file, count(*) AS n FROM calls GROUP BY ALL")
def normalized_hla_scan(spark, sf):
    """Loci in another spelling, absent ranks, a path that does not exist."""
    rows = _calls(read(spark, sf, "lineitem")).withColumns({"locus": F.concat(F.lit("hla_"), F.lower("locus")), "rank": F.when(F.col("rank") != 7, F.col("rank"))})
    path = shared.folder(spark) + "/calls.tsv"
    writers.table(rows, path)
    got = readers.normalized_hla(spark, path, path + ".none")
    return got.groupBy(*got.columns).agg(F.count("*").alias("n"))


# sheets, reports, stores


@query("manifest_scan", "SELECT 's' || s_suppkey AS sample_id, 'a' || s_suppkey AS abundance, 'v' || s_suppkey AS vcf FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0")
def manifest_scan(spark, sf):
    k = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(_text("s", k).alias("sample_id"), F.when(k % 4 != 0, _text("a", k)).alias("abundance"), F.when(k % 5 != 0, _text("v", k)).otherwise(" ").alias("vcf"))
    path = shared.folder(spark) + "/samples.csv"
    writers.table(rows, path, ",")
    return readers.manifest(spark, path)


@query("sample_list_scan", "SELECT DISTINCT 's' || o_custkey AS id FROM orders WHERE o_orderkey % 3 <> 0")
def sample_list_scan(spark, sf):
    """Comments, blanks and repeated lines."""
    line = _text(F.when(F.col("o_orderkey") % 3 == 0, "#").otherwise("  "), "s", F.col("o_custkey"), " ")
    return readers.sample_list(spark, _lines(read(spark, sf, "orders").select(line), shared.folder(spark) + "/samples", ["", "# head"])).select("id")


@query("key_value_scan", "WITH r AS (SELECT count(*) AS n, min(o_orderkey) AS least, max(o_orderstatus) AS last FROM orders) SELECT unnest(['n', 'least', 'last']) AS metric, unnest([n::VARCHAR, least::VARCHAR, last]) AS value FROM r")
def key_value_scan(spark, sf):
    row = read(spark, sf, "orders").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderstatus").alias("last"), F.lit(None).cast("string").alias("none"))
    path = shared.folder(spark) + "/report.tsv"
    writers.table(writers.metrics(row), path)
    return readers.key_values(spark, path)


@query("run_tables", "SELECT 'sample' AS metric, 's1' AS value UNION ALL SELECT 'input_records', count(*)::VARCHAR FROM orders UNION ALL SELECT 'a_rows', count(*)::VARCHAR FROM customer UNION ALL SELECT 'b_rows', count(*)::VARCHAR FROM supplier UNION ALL SELECT 'combined_rows', count(*)::VARCHAR FROM part UNION ALL SELECT 'a OK', count(*) || ' rows' FROM customer UNION ALL SELECT 'b ATTENTION', '0 rows' UNION ALL SELECT 'c SKIP', 'not run'")
def run_tables(spark, sf):
    """Summary and status of a run with one predictor that found nothing and one that was not run."""
    a, b = read(spark, sf, "customer"), read(spark, sf, "supplier")
    summary = writers.run_summary(read(spark, sf, "orders"), {"a": a, "b": b}, read(spark, sf, "part"), sample="s1")
    status = writers.run_status({"a": a, "b": b.where("s_suppkey < 0"), "c": None})
    return summary.unionByName(status.select(F.concat_ws(" ", "predictor", "status").alias("metric"), F.col("message").alias("value")))


@query("markdown_report", "WITH r AS (SELECT count(*) AS n, max(o_orderkey) / 4.0 AS top FROM orders) SELECT unnest(['# Run', '', '## Inputs', '', '- orders: `all`', '', '## Metrics', '', '| Metric | Value |', '|---|---:|', '| n rows | ' || n || ' |', '| top | ' || printf('%.6f', top::DOUBLE) || ' |']) AS value FROM r")
def markdown_report(spark, sf):
    row = read(spark, sf, "orders").agg(F.count("*").alias("n_rows"), (F.max("o_orderkey") / 4).alias("top"))
    return writers.markdown(row, "Run", {"orders": "all"})


@query("store_slice", SQL + "SELECT sample, tx, counts::DOUBLE AS counts FROM cnt WHERE sample IN (1, 3, 5) AND tx IN (SELECT unnest(range(1, 1000, 7)))")
def store_slice(spark, sf):
    """Chosen samples and ids of a store by sample; both choices reach the scan."""
    path = shared.folder(spark) + "/store"
    writers.by_sample(expression(spark, sf).select("sample", "tx", F.col("counts").cast("double").alias("counts")), path)
    return cohort.matrix_slice(spark.read.parquet(path), [1, 3, 5], list(range(1, 1000, 7)), id_col="tx").select(F.col("sample").cast("long").alias("sample"), "tx", "counts")


@query("chunked_slice", SQL + "SELECT sample::VARCHAR AS sample, tx::VARCHAR AS tx, counts::DOUBLE AS counts FROM cnt WHERE sample IN (1, 3, 5) AND tx IN (SELECT unnest(range(1, 1000, 7)))")
def chunked_slice(spark, sf):
    """The expression matrix as a chunked array with two string axes, and chosen rows and columns of it read back."""
    path = shared.folder(spark) + "/matrix"
    arrays.write_matrix(expression(spark, sf), path, "tx", "sample", "counts", (256, 64))
    cells = arrays.read(spark, path).where(F.col("col_id").isin("1", "3", "5") & F.col("row_id").isin([str(i) for i in range(1, 1000, 7)]))
    return cells.where("value is not null").select(F.col("col_id").alias("sample"), F.col("row_id").alias("tx"), F.col("value").alias("counts"))


@query("chunked_table", "SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal, c_acctbal > 0 AS positive FROM customer")
def chunked_table(spark, sf):
    """A table with strings, numbers and flags as a group of arrays, read back whole."""
    path = shared.folder(spark) + "/table"
    rows = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), (F.col("c_acctbal") > 0).alias("positive"))
    arrays.write_table(rows, path, [F.col("c_custkey")], 500)
    return arrays.read(spark, path, "table")


# genome, frameshifts, forest


@query("genome_slices", "SELECT doc_id, substr(text, (doc_id % 100 + 1)::BIGINT, (doc_id % 1500 + 1)::BIGINT) AS seq FROM documents WHERE text IS NOT NULL")
def genome_slices(spark, sf):
    """A stretch of every whole text, cut from pieces of 256 letters."""
    docs = sequences(spark, sf).where("text is not null").withColumn("chrom", F.col("doc_id"))
    spans = docs.select("chrom", (F.col("doc_id") % 100 + 1).alias("start"), (F.col("doc_id") % 100 + F.col("doc_id") % 1500 + 1).alias("end"))
    return readers.slices(readers.binned(docs.select("chrom", F.col("text").alias("seq")), 256), spans, 256).select(F.col("chrom").alias("doc_id"), "seq")


def _protein(dna: str) -> str:
    return f"split_part(list_aggregate(list_transform(range(0, length({dna}) // 3), lambda i: {_CODONS}[substr({dna}, CAST(3 * i + 1 AS INT), 3)]), 'string_agg', ''), '*', 1)"


_SHIFTS = f"""WITH d AS (SELECT doc_id, {_DNA} AS dna FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, dna, length(dna) // 3 AS h, length(dna) AS n, 'G' || (doc_id % 100) AS gene, doc_id % 3 = 0 AS back, doc_id % 2 = 1 AS second FROM d WHERE length(dna) >= 6),
e AS (SELECT *, substr(dna, 1, h) AS e1, substr(dna, 2 * h + 1) AS e2, CASE WHEN second THEN (n - 2 * h) // 2 - 1 ELSE h // 2 - 1 END AS off FROM g),
p AS (SELECT *, e1 || e2 AS w, CASE WHEN second THEN e1 || substr(e2, 1, off::INT) || 'G' || substr(e2, off::INT + 3) ELSE substr(e1, 1, off::INT) || 'G' || substr(e1, off::INT + 3) || e2 END AS m FROM e),
r AS (SELECT *, CASE WHEN back THEN reverse(translate(w, 'ACGT', 'TGCA')) ELSE w END AS w2, CASE WHEN back THEN reverse(translate(m, 'ACGT', 'TGCA')) ELSE m END AS m2 FROM p),
t AS (SELECT doc_id, gene, {_protein("w2")} AS wt, {_protein("m2")} AS mut FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY gene, mut ORDER BY doc_id) AS n FROM t WHERE length(mut) >= 6)
SELECT 'FRAMESHIFT_' || gene || '_T' || doc_id || ' type=DEL shift=-1bp WT=' || length(wt) || ' MUT=' || length(mut) || ' diff=' || (length(mut) - length(wt)) AS header, mut AS sequence FROM f WHERE n = 1"""


@query("frameshift_proteins", _SHIFTS)
def frameshift_proteins(spark, sf):
    """Every document, whole, as a chromosome with one transcript of two exons (its first and its last third) and a deletion
    in one of them."""
    letters = F.regexp_replace(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), "[^A-Z]", "")
    k, n, h, at = F.col("doc_id"), F.col("n"), F.col("h"), shared.folder(spark) + "/genome"
    cleaned = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC").alias("seq")
    read(spark, sf, "documents").where("text is not null").select(k, cleaned).write.parquet(at)  # once, not anew for each reader
    genome = spark.read.parquet(at).withColumns({"chrom": k.cast("string"), "n": F.length("seq")}).where("n >= 6").withColumn("h", F.floor(n / 3).cast("int"))
    exons = F.array(F.struct(F.lit(1).alias("start"), h.alias("end")), F.struct((2 * h + 1).alias("start"), n.alias("end")))
    tx = genome.select(_text("T", k).alias("transcript_id"), "chrom", F.when(k % 3 == 0, "-").otherwise("+").alias("strand"), _text("G", k % 100).alias("gene_id"), exons.alias("exons"))
    pos = F.when(k % 2 == 1, 2 * h + F.floor((n - 2 * h) / 2)).otherwise(F.floor(h / 2)).cast("int")
    found = genome.select("chrom", pos.alias("pos"), F.lit("AC").alias("ref"), F.lit("G").alias("alt"), k.alias("ord"))
    return proteome.frameshift_proteins(found, tx, genome.select("chrom", "seq")).select("header", "sequence")


_LEAVES = "SELECT count(*) FILTER (p_size % 2 = 0) AS a, count(*) FILTER (p_size % 2 = 1) AS b, count(*) FILTER (p_size % 3 = 0) AS c, count(*) FILTER (p_size % 5 = 1) AS d FROM part"


@query("forest_table", f"WITH l AS ({_LEAVES}), c AS (SELECT range AS code, concat(range // 7776 % 6, range // 1296 % 6, range // 216 % 6, range // 36 % 6, range // 6 % 6, range % 6) AS six FROM range(46656)) SELECT code, round(((CASE WHEN contains(six, '0') THEN b::DOUBLE / (a + b) ELSE a::DOUBLE / (a + b) END) + (CASE WHEN contains(six, '12') THEN d::DOUBLE / (c + d) ELSE c::DOUBLE / (c + d) END)) / 2, 9) AS prob FROM c, l")
def forest_table(spark, sf):
    """A forest of two trees whose leaves are counts of a table, as an export; tabulated over all six-mers, written in the
    binary form and read again."""
    size = F.col("p_size")
    a, b, c, d = read(spark, sf, "part").agg(*(F.count_if(x) for x in (size % 2 == 0, size % 2 == 1, size % 3 == 0, size % 5 == 1))).first()
    leaves = lambda var, no, yes: ([[1, 0, 0], [2, 0, 0]], [var, 0, 0], [0.5, 0, 0], [[], no, yes])
    parts = list(zip(leaves(0, [b, a], [a, b]), leaves(1, [d, c], [c, d]), strict=True))
    names = ["1_0", "2.3_0"]
    trees = dict(zip(("child_node_ids", "split_var_ids", "split_values", "terminal_class_counts"), parts, strict=True))
    export = {"imp_features": names, "independent_variable_names": ["X" + n for n in names], "enc": {str(i): [] for i in range(1, 7)}, "forest": {"num_trees": 2, **trees}}
    at = shared.folder(spark)
    models.write_bytes(spark, f"{at}/forest.json", json.dumps(export).encode())
    models.write_table(spark, models.tabulate(*models.load_forest(spark, f"{at}/forest.json", 2)), f"{at}/table.bin", b"TABLE_V1")
    table = spark.sparkContext.broadcast(readers.lookup_table(spark, f"{at}/table.bin"))
    of = F.pandas_udf(lambda code: code.map(table.value.__getitem__), "double")
    return spark.range(46656).select(F.col("id").alias("code"), F.round(of("id"), 9).alias("prob"))


@query("id_forms", "SELECT o_orderkey, 'ENST' || o_orderkey AS transcript, 'x|ENST' || o_orderkey AS stripped, ['haplotype_1', 'haplotype_2', 'frameshift', 'other'][o_orderkey % 4 + 1] AS kind, o_custkey % 3 = 0 AS flag, CASE WHEN o_custkey % 4 = 3 THEN NULL ELSE greatest(least(o_custkey % 4, 2), 1) END AS clipped, 'HLA-B*07:0' || (o_custkey % 5) AS allele, 'B' AS locus FROM orders")
def id_forms(spark, sf):
    """Ids, classes by prefix, flags in several spellings, bounds, allele names."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    name = _text("x|ENST", o, ".", o % 9)
    kept = F.when(c % 4 != 3, (c % 4).cast("int"))
    allele = _text(" hla_b*07:0", c % 5)
    return read(spark, sf, "orders").select("o_orderkey", sequence.transcript_id(name).alias("transcript"), sequence.strip_version(name).alias("stripped"), sequence.protein_class(F.concat(_pick(["H1_", "H2_", "FRAMESHIFT_", "z"], o % 4), name)).alias("kind"), labels.as_bool(_pick([" TRUE", "no", "0"], c % 3)).alias("flag"), labels.clip(kept, 1, 2).alias("clipped"), sequence.normal_allele(allele).alias("allele"), sequence.normal_locus(allele).alias("locus"))
