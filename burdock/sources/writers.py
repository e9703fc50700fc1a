"""Sinks: FASTA, id lists, prediction and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import wrap


def fasta(records: DataFrame, path: str, order: str = "ord") -> None:
    """80-column FASTA, sorted by ``order`` across the part files."""
    head = F.when(F.col("header").startswith(">"), F.col("header")).otherwise(F.concat(F.lit(">"), "header"))
    records.orderBy(order).select(F.concat(head, F.lit("\n"), wrap(F.col("sequence")))).write.mode("overwrite").text(path)


def ids(rows: DataFrame, path: str) -> None:
    rows.select("id").distinct().orderBy("id").write.mode("overwrite").text(path)


def ten_digits(x: Column) -> Column:
    """A double with at most ten significant digits and no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10g", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def table(rows: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    rows.write.mode(mode).csv(path, sep=sep, header=True)


def by_sample(rows: DataFrame, path: str, sample: str = "sample") -> None:
    """Columnar store of a cohort table, sorted by sample in ranges: the bounds that its files and row groups keep let a scan
    read the samples and columns it needs. The number of files is that of the ranges, however many samples there are."""
    other = [c for c, t in rows.dtypes if c != sample and t in ("string", "int", "bigint")]
    rows.repartitionByRange(sample, *other).sortWithinPartitions(sample, *other).write.mode("overwrite").parquet(path)


def metrics(row: DataFrame) -> DataFrame:
    """A one-row report as (metric, value) rows."""
    return row.select(*(F.col(c).cast("string") for c in row.columns)).unpivot([], row.columns, "metric", "value")


def report(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*row.columns)).alias("json"))


def digest(records: DataFrame) -> DataFrame:
    """md5 of the sorted (id, sequence) set: sorted hashes of the rows are hashed in turn, so no group of texts is gathered."""
    each = records.select(F.md5(F.concat_ws("\t", "id", "sequence")).alias("h")).distinct()
    part = each.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "\n")).alias("h"))
    return part.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n")).alias("digest"))


def markdown(row: DataFrame, title: str, inputs: dict[str, str] | None = None) -> DataFrame:
    """A one-row report as Markdown, one line a row: title, inputs and a table of the metrics; doubles with six digits."""
    shown = row.select(*(F.format_string("%.6f", F.coalesce(F.col(c), F.lit(0.0))).alias(c) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in row.dtypes))
    head = [f"# {title}", "", "## Inputs", "", *(f"- {k}: `{v}`" for k, v in (inputs or {}).items()), "", "## Metrics", "", "| Metric | Value |", "|---|---:|"]
    lines = [F.concat(F.lit(f"| {c.replace('_', ' ')} | "), F.col(c), F.lit(" |")) for c in row.columns]
    return shown.select(F.explode(F.array(*map(F.lit, head), *lines)).alias("value"))


def combined(tables: dict[str, DataFrame], key: str = "Sequence_ID") -> DataFrame:
    """Predictor tables (key, prob, pred) as one, by id, with the consensus; predictors without a row are NA."""
    from ..operators.cohort import merge_predictions

    return merge_predictions({n: t.withColumnRenamed(key, "id") for n, t in tables.items()}).withColumnRenamed("id", key).orderBy(key)


def run_summary(records: DataFrame, tables: dict[str, DataFrame], combined_rows: DataFrame, **facts: str) -> DataFrame:
    """(metric, value) rows of a run: facts, records read and rows of each table."""
    count = lambda df, name: df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("metric"), "value")
    rows = [count(records, "input_records"), *(count(t, f"{n}_rows") for n, t in tables.items()), count(combined_rows, "combined_rows")]
    spark = records.sparkSession
    out = spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "metric string, value string")
    for r in rows:
        out = out.unionByName(r)
    return out


def run_status(tables: dict[str, DataFrame | None], stamp: str = "NA") -> DataFrame:
    """timestamp, predictor, status, message: OK with rows, ATTENTION without, SKIP where a predictor did not run."""
    out = None
    for name, t in tables.items():
        if t is None:
            continue
        n = F.count("*")
        one = t.agg(F.when(n > 0, "OK").otherwise("ATTENTION").alias("status"), F.concat(n.cast("string"), F.lit(" rows")).alias("message")).select(F.lit(stamp).alias("timestamp"), F.lit(name).alias("predictor"), "status", "message")
        out = one if out is None else out.unionByName(one)
    for name in (k for k, t in tables.items() if t is None):
        out = out.unionByName(out.limit(1).select("timestamp", F.lit(name).alias("predictor"), F.lit("SKIP").alias("status"), F.lit("not run").alias("message"))) if out is not None else None
    return out
