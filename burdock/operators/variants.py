"""Hard filters of called variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits and names of the filters, bases and number of variants of a cluster.
FISHER_STRAND, QUALITY_BY_DEPTH = 30.0, 2.0
WINDOW, CLUSTER = 35, 3
#: Bases of a task's stretch.
STRETCH = 1 << 16


def info(name: str, col: str = "info") -> Column:
    """A number from a variant's INFO text; null if it is absent."""
    return F.nullif(F.regexp_extract(F.col(col), rf"(?:^|;){name}=([^;]+)", 1), F.lit("")).try_cast("double")


def hard_filters(rows: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Adds ``filter``: the names of the filters a variant fails, or PASS. Variants are marked, none goes.

    A variant is clustered if CLUSTER variants lie within WINDOW bases, itself among them. A variant without a value
    does not fail that value's filter. Work is split by stretches of STRETCH bases; what lies within WINDOW bases of a
    stretch is counted with it, so no task sees a whole chromosome. A variant without a place is in no cluster.
    """
    at = F.floor(F.col(pos) / STRETCH)
    near = F.array_distinct(F.array(F.floor((F.col(pos) - WINDOW) / STRETCH), at, F.floor((F.col(pos) + WINDOW) / STRETCH)))
    spread = rows.withColumns({"__own": at, "__bin": F.explode(F.when(F.col(pos).isNull(), F.array(F.lit(None).cast("long"))).otherwise(near))})
    w = Window.partitionBy(chrom, "__bin").orderBy(pos)
    counted = spread.withColumn("__back", F.count(pos).over(w.rangeBetween(-(WINDOW - 1), 0)))
    marked = counted.withColumn("__most", F.max("__back").over(w.rangeBetween(0, WINDOW - 1))).where(F.col("__own").eqNullSafe(F.col("__bin")))
    marks = F.concat_ws(";", F.when(F.col("__most") >= CLUSTER, "SnpCluster"), F.when(info("FS") > FISHER_STRAND, "FS"), F.when(info("QD") < QUALITY_BY_DEPTH, "QD"))
    return marked.withColumn("filter", F.when(marks == "", "PASS").otherwise(marks)).drop("__back", "__most", "__own", "__bin")
