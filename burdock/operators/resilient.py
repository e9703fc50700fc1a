"""Steps that survive: failing records are set apart with their error, finished chunks are kept and checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import readers
from . import scoring

#: Parts into which keyed results are cut.
CHUNKS = 64


def isolated(batch: pa.RecordBatch, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None, str | None]]:
    """(input, output, error) of pieces of a batch: the whole where ``fn`` succeeds, else its halves, down to single records
    that fail. ``k`` failing records of ``n`` cost about ``k`` log ``n`` calls more."""
    ahead = [batch]
    while ahead:
        piece = ahead.pop()
        try:
            out = fn(piece)
            if out.num_rows != piece.num_rows:
                raise ValueError(f"{out.num_rows} rows of {piece.num_rows}")
        except Exception as e:  # whatever a record does to the step
            if piece.num_rows <= 1:
                yield piece, None, f"{type(e).__name__}: {e}"
            else:
                half = piece.num_rows // 2
                ahead += [piece.slice(half), piece.slice(0, half)]
            continue
        yield piece, out, None


def apply_isolated(rows: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], keys: list[str], schema: str) -> DataFrame:
    """keys, the columns of ``schema`` and error of each row. ``fn`` maps a batch of all columns to a batch of ``schema`` with
    as many rows; a record it fails on has nulls and its error, and leaves the others of its batch as they are. An error of
    the worker itself (lost memory, a killed process) is not an exception and still fails the task."""
    held = [f for f in rows.schema.fields if f.name in keys]
    made = StructType.fromDDL(schema)
    full = StructType(held + made.fields).add("error", "string")
    target = to_arrow_schema(full)
    inner = to_arrow_schema(made)

    def run(batches):
        for b in batches:
            for piece, out, error in isolated(b, fn):
                n = piece.num_rows
                cols = out.cast(inner).columns if out is not None else [pa.nulls(n, f.type) for f in inner]
                yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in held), *cols, pa.array([error] * n, pa.string())], schema=target)

    return rows.mapInArrow(run, full)


def predict_isolated(spark: SparkSession, records: DataFrame, table: np.ndarray, id_col: str = "id", text_col: str = "sequence") -> DataFrame:
    """id, prob, error by the strict scorer, which refuses sequences without a window."""
    held = spark.sparkContext.broadcast(np.asarray(table, np.float64))

    def strict(batch):
        lens, best = scoring.windows(batch.column(1), held.value)
        if (short := np.flatnonzero(lens < 6)).size:
            raise ValueError(f"{int(lens[short[0]])} residues, 6 are needed")
        return pa.RecordBatch.from_arrays([pa.array(best)], names=["prob"])

    return apply_isolated(records.select(id_col, F.col(text_col).alias("__text")), strict, [id_col], "prob double")


def _signed(rows: DataFrame, id_col: str) -> DataFrame:
    """chunk, n, sign: rows of each chunk and a sum over its ids that does not hang on their order."""
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.xxhash64(id_col).cast("decimal(38,0)")).alias("sign"))


def chunk_states(spark: SparkSession, rows: DataFrame, out: str, chunks: int = CHUNKS, id_col: str = "id", columns: tuple[str, ...] = ("prob", "label", "status")) -> DataFrame:
    """chunk, n, valid: whether the results in ``out`` hold each record of the chunk once, and all columns."""
    want = _signed(rows.select(id_col, _chunk(id_col, chunks)), id_col)
    found = spark.read.parquet(out) if readers.first_existing(spark, out) else None
    if found is None or "chunk" not in found.columns or not {id_col, *columns} <= set(found.columns):
        return want.select("chunk", "n", F.lit(False).alias("valid"))
    have = _signed(found.select(id_col, F.col("chunk").cast("int").alias("chunk")), id_col).select("chunk", F.col("n").alias("__n"), F.col("sign").alias("__sign"))
    return want.join(have, "chunk", "left").select("chunk", "n", (F.col("n").eqNullSafe(F.col("__n")) & F.col("sign").eqNullSafe(F.col("__sign"))).alias("valid"))


def _chunk(id_col: str, chunks: int):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(chunks)).cast("int").alias("chunk")


def score_chunks(spark: SparkSession, rows: DataFrame, out: str, table: np.ndarray, chunks: int = CHUNKS, id_col: str = "id", text_col: str = "sequence") -> DataFrame:
    """Scores of all records under ``out``, one folder a chunk of ids; returns chunk, n, state (SKIPPED, DONE or FAILED).

    Chunks whose results hold exactly their records are left as they are; all others are scored anew in one job that
    replaces their folders alone, and are checked again. Rows of one id are one record: the first text in order counts.
    """
    once = rows.groupBy(id_col).agg(F.min(text_col).alias(text_col))
    before = chunk_states(spark, once, out, chunks, id_col).collect()  # as many rows as chunks
    anew = [r.chunk for r in before if not r.valid]
    if anew:
        todo = once.withColumn("chunk", _chunk(id_col, chunks)).where(F.col("chunk").isin(anew))
        found = scoring.predict(spark, todo, table, id_col, text_col).withColumn("chunk", _chunk(id_col, chunks))
        found.repartition("chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(out)
    after = {r.chunk: r.valid for r in chunk_states(spark, once, out, chunks, id_col).collect()} if anew else {}
    states = [(r.chunk, r.n, "SKIPPED" if r.valid else "DONE" if after.get(r.chunk) else "FAILED") for r in before]
    return spark.createDataFrame(states, "chunk int, n long, state string")
