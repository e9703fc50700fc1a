"""Command line: python -m burdock COMMAND ...; each command reads files, calls one operator and writes its table."""

from __future__ import annotations

import argparse
import dataclasses
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence
from .operators import proteome, runs, scoring
from .sources import models, readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="burdock")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, out: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        if out:
            p.add_argument("--out", required=True)
        return p

    p = command("clean-ids", "gtf")
    p.add_argument("--abundance")
    p.add_argument("--min-tpm", type=float, default=1.0)
    p.add_argument("--min-cds-bp", type=int, default=10)
    command("clean-proteins", "input")
    p = command("frameshifts", "vcf", "gtf", "genome", "ids")
    p.add_argument("--min-aa", type=int, default=6)
    command("combine").add_argument("fastas", nargs="+")
    command("nonsense-report", "input")
    command("verify").add_argument("fastas", nargs="+")
    p = command("predict", "input", "sixmer-table")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--top-k", type=int, default=0)
    for extra in ("top-tsv", "skipped-tsv", "report-json", "report-md"):
        p.add_argument(f"--{extra}")
    p = command("build-table", "model")
    p.add_argument("--magic", help="write the binary form with this first line")
    p.add_argument("--features", type=int, default=models.FEATURES)
    p = command("hla-normalize", "sample", "input")
    p.add_argument("--caller", required=True, choices=["json", "wide", "log"])
    p = command("verify-outputs", "dir")
    p = command("annotation", "gtf")
    p = command("hla-consensus")
    p.add_argument("--min-support", type=int, default=2)
    p.add_argument("--ploidy", type=int, default=2)
    p.add_argument("inputs", nargs="+")
    p = command("run", out=False)
    p.add_argument("--resume", action="store_true", help="read steps that are complete and were made with the same parameters")
    for f in dataclasses.fields(runs.Parameters):
        kind = {"float": float, "int": int, "str": str, "bool": lambda v: v.lower() == "true"}[f.type]
        p.add_argument(f"--{f.name.replace('_', '-')}", type=kind, **({"required": True} if f.default is dataclasses.MISSING else {"default": f.default}))
    return top


def _records(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("sequence", F.col(text)).where("sequence is not null and sequence <> ''")


def clean_ids(spark, a) -> None:
    tx = proteome.transcripts(readers.gtf(spark, a.gtf))
    if a.abundance:
        found = proteome.expressed_ids(tx, readers.abundance(spark, a.abundance), a.min_tpm, a.min_cds_bp)
    else:
        found = tx.where((F.col("cds_bp") >= a.min_cds_bp) & (F.size("exons") > 0)).select(F.col("transcript_id").alias("id"))
    writers.ids(found, a.out)


def clean_proteins(spark, a) -> None:
    rows = readers.fasta(spark, a.input)
    writers.fasta(_records(rows.withColumn("cut", sequence.cut_stops(F.col("sequence"))), "cut"), a.out)


def frameshifts(spark, a) -> None:
    wanted = readers.ids(spark, a.ids, strip=True)
    tx = proteome.transcripts(readers.gtf(spark, a.gtf)).join(wanted, F.col("clean_id") == F.col("id"), "left_semi")
    genome = readers.fasta(spark, a.genome).select(F.col("id").alias("chrom"), F.col("sequence").alias("seq"))
    writers.fasta(proteome.frameshift_proteins(readers.vcf(spark, a.vcf), tx, genome, a.min_aa), a.out)


def combine(spark, a) -> None:
    sets = [readers.fasta(spark, p) for p in a.fastas if readers.first_existing(spark, p)]
    if not sets:
        raise SystemExit("none of the inputs exists")
    rows = proteome.union_distinct(*(s.select(F.col("header").alias("id"), "sequence", "ord") for s in sets))
    writers.fasta(rows.select(F.col("id").alias("header"), "sequence", F.struct("file_ord", "ord").alias("ord")), a.out)


def nonsense_report(spark, a) -> None:
    writers.table(proteome.truncations(readers.fasta(spark, a.input)), a.out)


def verify(spark, a) -> int:
    """2 where an output is missing, empty or holds an empty record."""
    missing = [p for p in a.fastas if not readers.first_existing(spark, p)]
    rows = [proteome.verify({p: readers.fasta(spark, p).select("id", "sequence")}) for p in a.fastas if p not in missing]
    rows += [spark.createDataFrame([(p, "ATTENTION", "missing")], "check string, status string, message string") for p in missing]
    checks = reduce(DataFrame.unionByName, rows).cache()
    writers.table(checks, a.out)
    bad = checks.where("status <> 'OK'").limit(1).count()
    checks.unpersist()  # the same files may be checked again after a change
    return 2 if bad else 0


#: Names of the outputs of a sample's folder.
OUTPUTS = {"clean_ids": "clean_ids.txt", "protein": "protein.fasta", "frameshift": "frameshift_unique.fasta", "combined": "combine_proteome.fasta", "nonsense": "nonsense_candidates.txt"}


def verify_outputs(spark, a) -> int:
    """2 where an output of a sample's folder is missing, empty or too small for its parts."""
    read = lambda name, p: readers.fasta(spark, p) if p.endswith(".fasta") else spark.read.text(p).where("trim(value) <> ''")  # noqa: E731, ARG005
    held = {n: f"{a.dir}/{f}" for n, f in OUTPUTS.items()}
    checks = proteome.verify_outputs(spark, {n: read(n, p) if readers.first_existing(spark, p) else None for n, p in held.items()}).cache()
    writers.table(checks.select("status", "check", "message"), a.out)
    bad = checks.where("status <> 'OK'").limit(1).count()
    checks.unpersist()  # the same files may be checked again after a change
    return 2 if bad else 0


def annotation(spark, a) -> None:
    writers.table(readers.annotation(spark, a.gtf), a.out)


def predict(spark, a) -> None:
    if a.top_k < 0 or (a.top_tsv and not a.top_k):
        raise SystemExit("--top-tsv needs a positive --top-k")
    table = np.asarray(readers.lookup_table(spark, a.sixmer_table))
    rows = readers.fasta(spark, a.input)
    found = scoring.predict(spark, rows, table, threshold=a.threshold)
    ok = F.col("status") == "ok"
    named = (F.col("id").alias("Sequence_ID"), writers.ten_digits(F.col("prob")).alias("Prob"), F.col("label").alias("Pred"))
    writers.table(found.where(ok).select(*named), a.out, ",")
    if a.skipped_tsv:
        odd = readers.classified(rows).where(~ok)
        writers.table(odd.select(F.col("id").alias("Sequence_ID"), F.col("raw_length").alias("Raw_Length"), F.col("clean_length").alias("Clean_Length"), F.col("status").alias("Reason")), a.skipped_tsv)
    if a.top_tsv:
        writers.table(scoring.top_hits(found, a.top_k).select(F.col("rank").alias("Rank"), *named).orderBy("Rank"), a.top_tsv)
    if a.report_json:
        writers.report(scoring.run_report(found)).write.mode("overwrite").text(a.report_json)
    if a.report_md:
        digests = {r.path: r.sha256 for p in (a.input, a.sixmer_table) for r in readers.file_digests(spark, p).collect()}
        inputs = {"Input": a.input, "Output": a.out, "Six-mer table": a.sixmer_table, "Threshold": a.threshold} | {f"SHA256 of {p.rsplit('/', 1)[-1]}": d for p, d in digests.items()}
        writers.markdown(scoring.run_report(found), "Prediction report", inputs).coalesce(1).write.mode("overwrite").text(a.report_md)


def build_table(spark, a) -> None:
    names, trees = models.load_forest(spark, a.model, a.features)
    models.write_table(spark, models.tabulate(names, trees), a.out, a.magic.encode() if a.magic else None)


def hla_normalize(spark, a) -> None:
    if a.caller == "json":
        calls = readers.hla_json(spark.read.text(a.input, wholetext=True), a.sample, a.caller)
    elif a.caller == "wide":
        calls = readers.hla_table(spark, a.input, a.sample, a.caller)
    else:
        calls = readers.hla_log(spark.read.text(a.input), a.sample, a.caller)
    ranked = calls if "rank" in calls.columns else proteome.hla_ranks(calls.withColumn("ord", F.monotonically_increasing_id()))
    writers.table(ranked.select("sample", "caller", "locus", "allele", "rank", F.lit(a.input).alias("source_file")), a.out)


def hla_consensus(spark, a) -> None:
    calls = readers.normalized_hla(spark, *a.inputs)
    writers.table(proteome.hla_consensus(calls, a.min_support, a.ploidy).orderBy("sample", "locus", "allele"), a.out)


def run(spark, a) -> int:
    """A run over a sample sheet; 2 where a sample needs attention or lacks an input."""
    names = [f.name for f in dataclasses.fields(runs.Parameters)]
    out = runs.run(spark, runs.Parameters(**{n: getattr(a, n) for n in names}), a.resume)
    return 2 if out["states"].where("status <> 'OK'").limit(1).count() else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return globals()[args.command.replace("-", "_")](spark or SparkSession.builder.appName("burdock").getOrCreate(), args) or 0


if __name__ == "__main__":
    raise SystemExit(main())
