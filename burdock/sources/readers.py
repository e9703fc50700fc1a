"""Readers of FASTA, GTF, VCF, abundance, id lists, caller outputs and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import sequence


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, id, sequence, file, ord; records are split by the scan itself, lines of a sequence are joined.

    ``ord`` rises with the place in a file that is read as one split.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>|\r", "").alias("r"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"))
    head = F.trim(F.substring_index("r", "\n", 1))
    body = F.when(F.instr("r", "\n") > 0, F.regexp_replace(F.expr("substring(r, instr(r, '\n') + 1)"), r"\s", "")).otherwise("")
    return raw.where("trim(r) <> ''").select(head.alias("header"), F.regexp_extract(head, r"^\S+", 0).alias("id"), body.alias("sequence"), "file", "ord")


def classified(records: DataFrame, least: int = 6) -> DataFrame:
    """Adds clean, raw_length, clean_length and status."""
    out = records.withColumn("clean", sequence.clean(F.col("sequence")))
    return out.withColumns({"raw_length": F.length("sequence"), "clean_length": F.length("clean"), "status": sequence.scan_status(F.col("clean"), least)})


def strict(records: DataFrame) -> DataFrame:
    """The records; reading fails on a repeated id or an empty sequence."""
    odd = records.groupBy("id").agg(F.count("*").alias("n"), F.min(F.length("sequence")).alias("least")).where("n > 1 or least = 0").limit(1)
    if (bad := odd.first()) is not None:
        raise ValueError(f"repeated id or empty sequence: {bad.id}")
    return records


def gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("exon", "CDS")) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=schema.GTF, quote="").where(F.col("feature").isin(*features) & ~F.col("seqname").isin(*schema.MITOCHONDRIAL) & F.col("attribute").isNotNull())


def attribute(name: str, col: str = "attribute"):
    """The last value of a GTF attribute; null if there is none."""
    found = F.regexp_extract_all(col, F.lit(rf'(?:^|[^A-Za-z0-9_]){name} "([^"]+)"'), F.lit(1))
    return F.try_element_at(found, F.lit(-1))  # names ``found`` once, so the pattern runs once


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt (first), ord; FILTER is not looked at."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema.VCF).where("ALT is not null")
    return rows.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.upper("REF").alias("ref"), F.upper(F.split("ALT", ",")[0]).alias("alt"), F.monotonically_increasing_id().alias("ord"))


def alleles(rows: DataFrame, alt: str = "alt") -> DataFrame:
    """One row per alternative allele."""
    return rows.withColumn(alt, F.explode(F.split(alt, ",")))


def calls(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """chrom, pos, ref, alts (comma-joined), gt (of the first sample), ord, file of the rows of one or many files."""
    rows = spark.read.csv(paths, sep="\t", comment="#", schema=schema.VCF) if paths else spark.createDataFrame([], schema.VCF)
    file = F.col("_metadata.file_path") if paths else F.lit(None).cast("string")
    place = F.array_position(F.split("FORMAT", ":"), "GT").cast("int")
    return rows.where("ALT is not null").select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.upper("REF").alias("ref"), F.upper("ALT").alias("alts"), F.when(place > 0, F.get(F.split("sample", ":"), place - 1)).alias("gt"), F.monotonically_increasing_id().alias("ord"), file.alias("file"))


def abundance(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """TPM by transcript of one or many files; ``with_file`` adds the file of each row."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema.ABUNDANCE) if path else spark.createDataFrame([], schema.ABUNDANCE)
    if with_file:
        rows = rows.withColumn("file", F.col("_metadata.file_path") if path else F.lit(None).cast("string"))
    part = F.split("target_id", r"\|")
    return rows.withColumn("tpm", F.expr("try_cast(tpm as double)")).where("tpm is not null").withColumns({"transcript_id": part[0], "gene_id": F.get(part, F.lit(1)), "gene_name": F.get(part, F.lit(5))})


def ids(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).select((sequence.strip_version(line) if strip else line).alias("id")).where("id <> ''").distinct()


def predictions(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """CSV with any of several header names per column; of a repeated id the last row."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    named = rows.select(*(F.coalesce(*(F.col(f"`{n}`") for n in names if n in rows.columns)).alias(c) for c, names in columns.items()), F.monotonically_increasing_id().alias("ord"))
    key = next(iter(columns))
    return named.groupBy(key).agg(*(F.max_by(c, "ord").alias(c) for c in columns if c != key))


def hla_wide(rows: DataFrame, sample: str, caller: str) -> DataFrame:
    """First data row of a caller's wide table (A1 A2 B1 ...), one row per allele."""
    cols = [c for c in rows.columns if c.rstrip("12")]
    return rows.limit(1).unpivot([], cols, "locus", "allele").select(F.lit(sample).alias("sample"), F.lit(caller).alias("caller"), F.regexp_replace("locus", "[12]+$", "").alias("locus"), sequence.normal_allele(F.col("allele")).alias("allele")).where("allele is not null")


def hla_log(lines: DataFrame, sample: str, caller: str) -> DataFrame:
    """Alleles anywhere in a log's lines."""
    hits = F.regexp_extract_all("value", F.lit(f"({sequence.HLA})"), F.lit(1))
    allele = sequence.normal_allele(F.col("a"))
    return lines.select(F.explode(hits).alias("a")).select(F.lit(sample).alias("sample"), F.lit(caller).alias("caller"), sequence.allele_locus(allele).alias("locus"), allele.alias("allele")).where("allele is not null")


def hla_json(text: DataFrame, sample: str, caller: str) -> DataFrame:
    """Alleles in any string, keys included, at any depth below the top level of an object, in the order of the text;
    a name that occurs again counts once. ``rank`` is the place among the locus's alleles."""
    literal = F.regexp_extract_all("raw", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    top = text.select(F.monotonically_increasing_id().alias("file"), F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("key", "e"))
    raw = top.select("file", "key", F.col("e.value").alias("raw")).where("raw is not null")
    each = raw.select("file", "key", F.posexplode(F.when(F.col("raw").rlike(r"^\s*[\[{]"), literal).otherwise(F.array("raw"))).alias("at", "s"))
    allele = sequence.normal_allele(F.col("s"))
    found = each.select(allele.alias("allele"), F.struct("file", "key", "at").alias("ord")).where("allele is not null")
    first = found.groupBy(sequence.allele_locus(F.col("allele")).alias("locus"), "allele").agg(F.min("ord").alias("ord"))
    return first.select(F.lit(sample).alias("sample"), F.lit(caller).alias("caller"), "locus", "allele", F.row_number().over(Window.partitionBy("locus").orderBy("ord")).alias("rank"))


def delimiter(spark: SparkSession, path: str, candidates: str = "\t,") -> str:
    """The candidate that the first line of a text file has most of; the first candidate if it has none."""
    line = spark.read.text(path).limit(1).first()
    return max(candidates, key=(line.value if line else "").count)


def hla_table(spark: SparkSession, path: str, sample: str, caller: str) -> DataFrame:
    """``hla_wide`` of a file separated by tabs or commas."""
    return hla_wide(spark.read.csv(path, sep=delimiter(spark, path), header=True), sample, caller)


def normalized_hla(spark: SparkSession, *paths: str) -> DataFrame:
    """Calls of normalized tables; paths that do not exist are passed over, and so are rows without sample, caller, locus
    or allele. A rank that is absent is 999, one that is no number drops its row; the file stands in for an absent source."""
    there = [p for p in paths if first_existing(spark, p)]
    names = [f.split()[0] for f in schema.HLA.split(", ")]
    if not there:
        return spark.createDataFrame([], schema.HLA)
    rows = spark.read.csv(there, sep="\t", header=True, schema=", ".join(f"{n} string" for n in names)).withColumn("file", F.input_file_name())
    rank = F.col("rank").try_cast("int")
    kept = rows.where("sample is not null and caller is not null and locus is not null and allele is not null").where(F.col("rank").isNull() | rank.isNotNull())
    return kept.select("sample", "caller", sequence.normal_locus(F.col("locus")).alias("locus"), "allele", F.coalesce(rank, F.lit(999)).alias("rank"), F.coalesce("source_file", "file").alias("source_file"))


def manifest(spark: SparkSession, path: str, needed: tuple[str, ...] = ("sample_id", "abundance", "vcf")) -> DataFrame:
    """Rows of a sample sheet that have all needed columns."""
    rows = spark.read.csv(path, header=True)
    return rows.where(" AND ".join(f"coalesce(trim({c}), '') <> ''" for c in needed))


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """id, ord: lines of a text file without comments and blanks, each once, in order of first appearance."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("id"), F.monotonically_increasing_id().alias("ord")).where("id <> '' and not startswith(id, '#')")
    return rows.groupBy("id").agg(F.min("ord").alias("ord"))


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """transcript (version-free), gene_id, gene_name, biotype: the first row of each transcript in a GTF."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=schema.GTF, quote="").where("feature = 'transcript' and attribute is not null").withColumn("ord", F.monotonically_increasing_id())
    first = lambda key: F.nullif(F.regexp_extract("attribute", f'{key} "([^"]+)"', 1), F.lit(""))
    named = rows.select(sequence.transcript_id(first("transcript_id")).alias("transcript"), F.struct("ord", first("gene_id").alias("gene_id"), first("gene_name").alias("gene_name"), first("transcript_type").alias("biotype")).alias("x"))
    return named.groupBy("transcript").agg(F.min("x").alias("x")).select("transcript", "x.gene_id", "x.gene_name", "x.biotype")


def _tolerant(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    if first_existing(spark, path) is None:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    rows = spark.read.csv(path, sep="\t", header=True, encoding="UTF-8")
    return rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) rows of a report; of a repeated metric the last; none if the file is missing."""
    rows = _tolerant(spark, path, ("metric", "value")).where("metric is not null and value is not null").withColumn("ord", F.monotonically_increasing_id())
    return rows.groupBy("metric").agg(F.max_by("value", "ord").alias("value"))


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table of skipped records; none if the file is missing."""
    return _tolerant(spark, path, ("Sequence_ID", "Raw_Length", "Clean_Length", "Reason"))


def report(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A JSON report with the given columns; no row if the file is missing."""
    return spark.read.json(path, schema=columns, multiLine=True) if first_existing(spark, path) else spark.createDataFrame([], columns)


def slices(genome: DataFrame, spans: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``spans`` (chrom, start, end, from 1) with ``seq``, cut from a genome stored in pieces of ``width`` (chrom, bin, seq):
    a span meets the pieces it touches alone, so no chromosome travels. What lies outside the genome is empty."""
    first, last = (F.floor((F.col(c) - 1) / width).cast("int") for c in ("start", "end"))
    keyed = spans.withColumn("__span", F.monotonically_increasing_id()).withColumn("bin", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start") - F.col("bin") * width, F.lit(1)).cast("int")
    high = F.least(F.col("end") - F.col("bin") * width, F.lit(width)).cast("int")
    cut = keyed.join(genome, ["chrom", "bin"], "left").withColumn("part", F.substring("seq", low, high - low + 1))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("bin", "part"))), lambda x: x["part"])
    return cut.groupBy("__span", *spans.columns).agg(F.array_join(parts, "").alias("seq")).drop("__span")


def binned(genome: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(chrom, seq) as pieces (chrom, bin, seq) for ``slices``."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("seq") - 1) / width).cast("int"), F.lit(0))))
    return genome.select("chrom", "seq", at.alias("bin")).select("chrom", "bin", F.expr(f"substring(seq, bin * {width} + 1, {width})").alias("seq"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of each file; a file must fit a row (2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lookup_table(spark: SparkSession, path: str) -> list[float]:
    """Six-mer probabilities from JSON or from the binary form (a magic line, then little-endian doubles), told apart by the first bytes."""
    import json

    import numpy as np

    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if raw[:1] in b"[{":
        got = json.loads(raw)
        table = got if isinstance(got, list) else got["table"]
    else:
        table = np.frombuffer(raw[raw.index(b"\n") + 1 :], "<f8").tolist()
    if len(table) != schema.SIXMERS:
        raise ValueError(f"{len(table)} entries instead of {schema.SIXMERS}")
    return table


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    return None
