"""Runs over a sample sheet: each step is one DataFrame over all samples, keyed by sample.

Inputs of one kind are read in one scan over all samples' files, and which file is whose is a join. Transcripts, coding
slices and scores do not hang on a sample, so they are made once: a haplotype is translated anew only where a sample's
variants fall into its coding slices, and each distinct protein is scored once and joined back. Samples that lack an input
take no part and say so in the table of states. Each step's table is written by the run (Parquet under ``outdir``); with
``resume`` a step whose table is complete and was made with the same parameters is read instead.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import profiles, sequence
from ..sources import readers
from . import proteome, scoring

#: The modes of a run that start from prepared inputs or from sequences.
MODES = ("prepared", "amyloid")


@dataclass(frozen=True)
class Parameters:
    """Of a run; ``check`` is called before anything is read."""

    mode: str
    outdir: str = ""
    samples: str = ""
    ref_genome: str = ""
    ref_gtf: str = ""
    sixmer_table: str = ""
    input_fasta: str = ""
    min_tpm: float = 1.0
    min_cds_bp: int = 10
    min_frameshift_aa: int = 6
    threshold: float = 0.5
    top_k: int = 0
    run_protein_features: bool = True

    def check(self) -> None:
        """Raises ValueError with everything that is wrong."""
        needed = {"prepared": ("outdir", "samples", "ref_genome", "ref_gtf", "sixmer_table"), "amyloid": ("outdir", "input_fasta", "sixmer_table")}
        if self.mode not in MODES:
            raise ValueError(f"unsupported mode {self.mode!r}: {', '.join(MODES)}")
        wrong = [f"{self.mode} mode needs {name}" for name in needed[self.mode] if not getattr(self, name)]
        for f in fields(self):
            kind = {"float": (int, float), "int": int, "bool": bool, "str": str}[f.type]
            value = getattr(self, f.name)
            if not isinstance(value, kind) or (isinstance(value, bool) and f.type != "bool"):
                wrong.append(f"{f.name} must be a {f.type}")
        if not wrong:
            wrong += [f"{name} must be at least {least}" for name, least in (("min_tpm", 0), ("min_cds_bp", 1), ("min_frameshift_aa", 1), ("top_k", 0)) if getattr(self, name) < least]
            wrong += ["threshold must be between 0 and 1"] if not 0 <= self.threshold <= 1 else []
        if wrong:
            raise ValueError("; ".join(wrong))


def sheet(spark: SparkSession, path: str, needed: tuple[str, ...] = ("sample_id", "abundance", "vcf")) -> DataFrame:
    """sample, the needed paths and missing (what a row lacks: a column without a value or a file that is not there). A
    sample of several rows is an error. The file system is asked once for each path of the sheet."""
    rows = spark.read.csv(path, header=True)
    if lacks := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"the sample sheet lacks {', '.join(lacks)}")
    held = rows.select(*(F.trim(c).alias(c) for c in needed)).where(f"coalesce({needed[0]}, '') <> ''").collect()
    names = [r[0] for r in held]
    if len(set(names)) < len(names):
        raise ValueError("a sample stands in the sheet twice")
    out = [(r[0], *(v or None for v in r[1:]), [c for c, v in zip(needed[1:], r[1:], strict=True) if not v or readers.first_existing(spark, v) is None]) for r in held]
    return spark.createDataFrame(out, ", ".join(["sample string", *(f"{c} string" for c in needed[1:]), "missing array<string>"]))


def _address(spark: SparkSession, path: str) -> str:
    """A path as the scan names it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def of_samples(spark: SparkSession, held: DataFrame, col: str, read) -> DataFrame:
    """``read(paths)`` of all samples' files in one scan (its column ``file`` says which), with the sample of each row. A
    path may be a file or a folder; a file of several samples counts for each."""
    paths = [(r["sample"], r[col]) for r in held.select("sample", col).collect()]
    if not paths:
        return read([]).drop("file").withColumn("sample", F.lit(None).cast("string"))
    whose = spark.createDataFrame([(s, _address(spark, p).replace("file:///", "file:/").rstrip("/")) for s, p in paths], "sample string, __at string")
    rows = read(sorted({p for _, p in paths})).withColumn("file", F.replace(F.col("file"), F.lit("file:///"), F.lit("file:/")))
    named = whose.groupBy("__at").agg(F.collect_list("sample").alias("__who"))  # as many rows as the sheet
    near = rows.withColumn("__up", F.regexp_replace("file", "/[^/]*$", ""))
    own = near.join(F.broadcast(named), near["file"] == named["__at"]).drop("__at")
    inside = near.join(F.broadcast(named), near["__up"] == named["__at"]).drop("__at")
    return own.unionByName(inside).withColumn("sample", F.explode("__who")).drop("__who", "__up", "file")


def expressed(tx: DataFrame, abundance: DataFrame, min_tpm: float, min_cds: int) -> DataFrame:
    """sample, transcript_id of transcripts with exons and enough coding length whose TPM in the sample, under the full or
    the version-free id, is above ``min_tpm``."""
    fit = tx.where((F.col("cds_bp") >= min_cds) & (F.size("exons") > 0)).select("transcript_id", "clean_id")
    on = abundance.where(F.col("tpm") > min_tpm).select("sample", F.col("transcript_id").alias("k")).distinct()
    ids = fit.select("transcript_id", F.explode(F.array_distinct(F.array("transcript_id", "clean_id"))).alias("k"))
    return on.join(ids, "k").select("sample", "transcript_id").distinct()


def coding_slices(features: DataFrame, genome: DataFrame) -> DataFrame:
    """transcript_id, chrom, strand, start, end, seq of each coding stretch; ``genome`` is (chrom, seq)."""
    cds = features.where("feature = 'CDS'").select(readers.attribute("transcript_id").alias("transcript_id"), F.col("seqname").alias("chrom"), "strand", "start", "end").where("transcript_id is not null").distinct()
    known = cds.join(genome.select("chrom").distinct(), "chrom", "left_semi")
    return readers.slices(readers.binned(genome), known)


def haplotype_alleles(variants: DataFrame) -> DataFrame:
    """sample, chrom, pos, alt and gt (1 where a haplotype has this allele) of single-letter exchanges; ``variants``: sample,
    chrom, pos, ref, alts (comma-joined), gt."""
    one = variants.select("sample", "chrom", "pos", "ref", F.posexplode(F.split("alts", ",")).alias("__i", "alt"), F.split("gt", r"[|/]").alias("__gt")).where((F.length("ref") == 1) & (F.length("alt") == 1))
    has = lambda h: F.when(F.get("__gt", F.lit(h)) == (F.col("__i") + 1).cast("string"), "1").otherwise("0")
    return one.select("sample", "chrom", "pos", "alt", F.concat(has(0), F.lit("|"), has(1)).alias("gt"))


def haplotypes(snps: DataFrame, cds: DataFrame, wanted: DataFrame) -> DataFrame:
    """sample, id (H1_ or H2_ and the transcript), sequence of the wanted (sample, transcript_id). Of several alleles at
    one place the last in order counts. A transcript is translated once, a haplotype only where it changes what was read."""
    whole = cds.groupBy("transcript_id").agg(F.min("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("parts")).withColumn("dna", F.array_join("parts.seq", ""))
    told = whole.withColumn("sequence", sequence.translate_dna(proteome.on_strand(F.col("dna")))).withColumn("stretch", proteome.read_stretch(F.col("dna"), F.col("sequence"))).drop("dna")
    plain = told.select("transcript_id", "sequence")
    spans = cds.select("transcript_id", "chrom", "start", "end")
    hit = proteome.range_join(snps, spans, "chrom", "pos", "start", "end").join(wanted, ["sample", "transcript_id"], "left_semi")
    both = hit.select("sample", "transcript_id", "start", "pos", "alt", F.explode(F.filter(F.array(*(F.when(F.get(F.split("gt", r"\|"), F.lit(h)) == "1", h + 1) for h in (0, 1))), lambda x: x.isNotNull())).alias("h"))
    edits = both.groupBy("sample", "h", "transcript_id").agg(F.array_sort(F.collect_set(F.struct("start", "pos", "alt"))).alias("edits"))

    def edited(part):
        own = F.filter("edits", lambda e: e["start"] == part["start"])
        return F.struct(part["start"].alias("start"), F.aggregate(own, part["seq"], lambda s, e: F.overlay(s, e["alt"], e["pos"] - e["start"] + 1)).alias("seq"))

    changed = edits.join(told, "transcript_id").withColumn("parts", F.array_sort(F.transform("parts", edited)))
    made = proteome.retranslated(changed.withColumn("dna", F.array_join("parts.seq", "")).drop("edits", "parts"), "dna", "stretch", "sequence")
    rows = wanted.join(plain, "transcript_id").withColumn("h", F.explode(F.array(F.lit(1), F.lit(2)))).join(made.select("sample", "h", "transcript_id", "own"), ["sample", "h", "transcript_id"], "left")
    return rows.select("sample", F.concat(F.lit("H"), F.col("h").cast("string"), F.lit("_"), "transcript_id").alias("id"), F.coalesce("own", "sequence").alias("sequence"))


def scored(proteins: DataFrame, table: np.ndarray, threshold: float) -> DataFrame:
    """Proteins with prob, label, clean_length and status; each distinct sequence is scored once."""
    spark = proteins.sparkSession
    once = scoring.predict(spark, proteins.select(F.col("sequence").alias("k")).distinct(), table, "k", "k", threshold)
    return proteins.join(once, proteins["sequence"] == once["k"]).drop("k")


class Tables:
    """The tables of a run under ``outdir``. A table counts as complete if Spark's mark of a finished write and a record of
    the same parameters stand beside it."""

    def __init__(self, spark: SparkSession, params: Parameters, resume: bool):
        self.spark, self.root, self.resume = spark, params.outdir.rstrip("/"), resume
        self.digest = hashlib.sha256(json.dumps(asdict(params), sort_keys=True).encode()).hexdigest()
        self.held: dict[str, DataFrame] = {}
        self.reused: list[str] = []

    def step(self, name: str, make) -> DataFrame:
        """The table of a step: read if it is complete, else made by ``make()`` and written."""
        at, mark = f"{self.root}/{name}", f"{self.root}/_made/{name}"
        same = self.resume and readers.first_existing(self.spark, f"{at}/_SUCCESS") and readers.first_existing(self.spark, mark) and self.spark.read.text(mark).first()[0] == self.digest
        if same:
            self.reused.append(name)
        else:
            make().write.mode("overwrite").parquet(at)
            self.spark.createDataFrame([(self.digest,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
        self.held[name] = self.spark.read.parquet(at)
        return self.held[name]


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each sample; of equal ones the larger id is chosen, as for one sample."""
    w = Window.partitionBy("sample").orderBy(F.desc("prob"), F.desc("id"))
    return rows.where("status = 'ok'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _state(name: str, rows: DataFrame) -> DataFrame:
    """sample, step, n: rows of one step by sample."""
    return rows.groupBy("sample").agg(F.count("*").alias("n")).select("sample", F.lit(name).alias("step"), "n")


def states(held: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """sample, step, status, n, message for every sample of the sheet and every step: OK, ATTENTION without rows, SKIP where
    the sample lacks an input."""
    counts = None
    for name, rows in tables.items():
        counts = _state(name, rows) if counts is None else counts.unionByName(_state(name, rows))
    grid = held.select("sample", "missing", F.explode(F.array(*map(F.lit, tables))).alias("step"))
    n = F.coalesce("n", F.lit(0))
    lacks = F.size("missing") > 0
    status = F.when(lacks, "SKIP").when(n > 0, "OK").otherwise("ATTENTION")
    message = F.when(lacks, F.concat(F.lit("missing: "), F.array_join("missing", ", "))).otherwise(F.concat(n.cast("string"), F.lit(" rows")))
    return grid.join(counts, ["sample", "step"], "left").select("sample", "step", status.alias("status"), n.alias("n"), message.alias("message"))


def consistent(tables: dict[str, DataFrame]) -> DataFrame:
    """sample, ok: whether a sample's combined set holds no fewer records than each of its parts has distinct ones."""
    counts = None
    for name in ("proteins", "frameshifts", "combined"):
        one = tables[name].select("sample", "id", "sequence").distinct().groupBy("sample").agg(F.count("*").alias("n")).select("sample", F.lit(name).alias("step"), "n")
        counts = one if counts is None else counts.unionByName(one)
    of = lambda k: F.coalesce(F.max(F.when(F.col("step") == k, F.col("n"))), F.lit(0))
    return counts.groupBy("sample").agg(((of("combined") >= of("proteins")) & (of("combined") >= of("frameshifts"))).alias("ok"))


def _predicted(steps: Tables, combined: DataFrame, params: Parameters, table: np.ndarray) -> None:
    found = steps.step("predictions", lambda: scored(combined.select("sample", "id", "sequence"), table, params.threshold).select("sample", "id", "clean_length", "prob", "label", "status"))
    if params.top_k:
        steps.step("top", lambda: _top(found, params.top_k))
    if params.run_protein_features:
        once = lambda: profiles.light_features(combined.select("sequence").distinct(), "sequence")
        steps.step("features", lambda: combined.select("sample", "id", "sequence").join(once(), "sequence").drop("sequence"))


def prepared(spark: SparkSession, params: Parameters, steps: Tables) -> DataFrame:
    """From a sheet of abundances and variant calls to proteomes, predictions and features of all its samples."""
    table = np.asarray(readers.lookup_table(spark, params.sixmer_table))
    held = sheet(spark, params.samples)
    ready = held.where(F.size("missing") == 0)
    features = readers.gtf(spark, params.ref_gtf)
    genome = readers.fasta(spark, params.ref_genome).select(F.col("id").alias("chrom"), F.col("sequence").alias("seq"))
    tx = steps.step("transcripts", lambda: proteome.transcripts(features))
    wanted = steps.step("clean_ids", lambda: expressed(tx, of_samples(spark, ready, "abundance", lambda p: readers.abundance(spark, p, True)), params.min_tpm, params.min_cds_bp))
    calls = steps.step("variants", lambda: of_samples(spark, ready, "vcf", lambda p: readers.calls(spark, p)))
    cds = steps.step("coding", lambda: coding_slices(features, genome))
    raw = steps.step("haplotypes", lambda: haplotypes(haplotype_alleles(calls), cds, wanted))
    proteins = steps.step("proteins", lambda: raw.withColumn("sequence", sequence.cut_stops(F.col("sequence"))).where("sequence is not null"))
    shifts = steps.step("frameshifts", lambda: proteome.frameshift_proteins(calls.withColumn("alt", F.split("alts", ",")[0]), tx, genome, params.min_frameshift_aa, ("sample",), wanted).select("sample", F.col("header").alias("id"), "sequence"))
    both = lambda: proteins.select("sample", "id", "sequence").unionByName(shifts.select("sample", "id", "sequence")).distinct()
    combined = steps.step("combined", both)
    steps.step("truncations", lambda: proteome.truncations(proteins.withColumn("ord", F.lit(0)), by=("sample",)))
    _predicted(steps, combined, params, table)
    counted = {k: steps.held[k] for k in ("clean_ids", "haplotypes", "proteins", "frameshifts", "combined", "predictions")}
    out = states(held, counted)
    odd = consistent(steps.held).where("not ok").select("sample", F.lit("consistency").alias("step"), F.lit("ATTENTION").alias("status"), F.lit(0).cast("long").alias("n"), F.lit("the combined set is smaller than a part").alias("message"))
    return out.unionByName(odd)


def amyloid(spark: SparkSession, params: Parameters, steps: Tables) -> DataFrame:
    """Predictions and features of the sequences of one FASTA file or of a folder of them; a file is a sample."""
    table = np.asarray(readers.lookup_table(spark, params.sixmer_table))
    name = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.(fa|fasta|faa)(\.gz)?$", "")
    combined = steps.step("combined", lambda: readers.fasta(spark, params.input_fasta).select(name.alias("sample"), "id", "sequence"))
    _predicted(steps, combined, params, table)
    held = combined.select("sample").distinct().withColumn("missing", F.array().cast("array<string>"))
    return states(held, {k: steps.held[k] for k in ("combined", "predictions")})


def run(spark: SparkSession, params: Parameters, resume: bool = False) -> dict[str, DataFrame]:
    """All tables of a run, by name; ``states`` says how each sample fared in each step."""
    params.check()
    steps = Tables(spark, params, resume)
    out = {"prepared": prepared, "amyloid": amyloid}[params.mode](spark, params, steps)
    steps.resume = False  # the states are of this run
    steps.step("states", lambda: out)
    return steps.held
