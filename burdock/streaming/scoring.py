"""Incremental scoring of a landing folder: each trigger scores the files that are new, exactly once per checkpoint."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring
from ..sources import readers


def score_landing(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, table: np.ndarray, id_col: str = "id", text_col: str = "sequence") -> StreamingQuery:
    """Score all files now in ``landing`` (Parquet) and append them to ``out``; run again for files that come later."""
    rows = spark.readStream.schema(schema).parquet(landing)
    scored = scoring.predict(spark, rows, table, id_col, text_col)
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_keyed(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, table: np.ndarray, id_col: str = "id", text_col: str = "sequence", files: int | None = None) -> StreamingQuery:
    """Score all files now in ``landing``, each id once however often it comes, into one folder of ``out`` a batch.

    A batch leaves out ids that earlier batches of the ledger hold, replaces its own folder, counts what it has written and
    only then writes its line of the ledger (``out/_ledger``): batch, rows, a sum over its ids. A run that is stopped does
    its last batch anew and gives the same folder. ``keyed_results`` reads what the ledger vouches for. ``files``: of a
    batch, at most.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(landing)

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        once = batch.groupBy(id_col).agg(F.min(text_col).alias(text_col))
        held = keyed_results(session, out, before=number)
        new = once.join(held.select(id_col), id_col, "left_anti") if held is not None else once
        at = f"{out}/batch={number}"
        scoring.predict(session, new, table, id_col, text_col).write.mode("overwrite").parquet(at)
        line = session.read.parquet(at).agg(F.lit(number).alias("batch"), F.count("*").alias("n"), _sign(id_col).alias("sign"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{out}/_ledger/line={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _sign(id_col: str):
    return F.coalesce(F.sum(F.xxhash64(id_col).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def keyed_ledger(spark: SparkSession, out: str, id_col: str = "id") -> DataFrame | None:
    """batch, n, sign, valid: the ledger's lines, and whether their folders still hold what they say; None without any."""
    if readers.first_existing(spark, f"{out}/_ledger") is None:
        return None
    lines = spark.read.parquet(f"{out}/_ledger").select("batch", "n", "sign")
    batches = [r.batch for r in lines.select("batch").collect()]  # a line a batch
    there = [b for b in batches if readers.first_existing(spark, f"{out}/batch={b}")]
    if not there:
        return lines.withColumn("valid", F.lit(False))
    rows = spark.read.option("basePath", out).parquet(*(f"{out}/batch={b}" for b in there))
    found = rows.groupBy(F.col("batch").cast("int").alias("batch")).agg(F.count("*").alias("__n"), _sign(id_col).alias("__sign"))
    both = lines.join(found, "batch", "left")
    return both.select("batch", "n", "sign", ((F.col("n") == F.coalesce("__n", F.lit(0))) & (F.col("sign") == F.coalesce("__sign", F.lit(0).cast("decimal(38,0)")))).alias("valid"))


def keyed_results(spark: SparkSession, out: str, before: int | None = None, id_col: str = "id") -> DataFrame | None:
    """Scores of all batches that the ledger vouches for (``before``: of earlier batches than that one); None without any."""
    ledger = keyed_ledger(spark, out, id_col)
    if ledger is None:
        return None
    good = [r.batch for r in ledger.where("valid").collect() if before is None or r.batch < before]
    return spark.read.option("basePath", out).parquet(*(f"{out}/batch={b}" for b in sorted(good))).drop("batch") if good else None


def mend_keyed(spark: SparkSession, landing: str, schema: str, out: str, table: np.ndarray, id_col: str = "id", text_col: str = "sequence") -> int:
    """Records that batches which no longer hold what the ledger says should have are scored anew, as a batch of their own;
    the number of records. Only what has come in so far is looked at."""
    ledger = keyed_ledger(spark, out, id_col)
    if ledger is None or not ledger.where("not valid").limit(1).count():
        return 0
    lines = ledger.collect()
    held = keyed_results(spark, out, id_col=id_col)
    once = spark.read.schema(schema).parquet(landing).groupBy(id_col).agg(F.min(text_col).alias(text_col))
    lost = once.join(held.select(id_col), id_col, "left_anti") if held is not None else once
    first = min(r.batch for r in lines if not r.valid)
    at = f"{out}/batch={first}"
    spare = f"{out}/_mended"
    scoring.predict(spark, lost, table, id_col, text_col).write.mode("overwrite").parquet(spare)
    mended = spark.read.parquet(spare)
    mended.write.mode("overwrite").parquet(at)
    for r in lines:
        if r.valid:
            continue
        line = (spark.read.parquet(at) if r.batch == first else mended.limit(0)).agg(F.lit(r.batch).alias("batch"), F.count("*").alias("n"), _sign(id_col).alias("sign"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{out}/_ledger/line={r.batch}")
        if r.batch != first:
            mended.limit(0).write.mode("overwrite").parquet(f"{out}/batch={r.batch}")
    return mended.count()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts and sums by event type; works on a stream (with a watermark) and on a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
