"""Best-window six-mer scoring with a tabulated model, top hits and run reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from ..functions.sixmers import counts, steps, windows
from ..schema import SIXMERS

def best_windows(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` of a list."""
    return windows(pa.array(texts, pa.string()), table)


def surrogate_table() -> np.ndarray:
    """A stand-in for a fitted table: code / (codes - 1)."""
    return np.arange(SIXMERS) / (SIXMERS - 1)


def scorer(spark: SparkSession, table: np.ndarray):
    """Column function text -> struct(clean_length, prob); the table (365 KB) is broadcast."""
    held = spark.sparkContext.broadcast(np.asarray(table, np.float64))

    @F.pandas_udf("clean_length int, prob double")
    def score(s: pd.Series) -> pd.DataFrame:
        lens, best = best_windows(s.tolist(), held.value)
        return pd.DataFrame({"clean_length": lens.astype(np.int32), "prob": pd.array(best, "Float64")})

    return score


def predict(spark: SparkSession, records: DataFrame, table: np.ndarray, id_col: str = "id", text_col: str = "sequence", threshold: float = 0.5) -> DataFrame:
    """id, clean_length, prob, label, status of every record; too short ones carry their reason instead of a label.

    One Arrow pass over id and text; the table (365 KB) is broadcast."""
    held = spark.sparkContext.broadcast(np.asarray(table, np.float64))
    rows = records.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))

    def run(batches):
        for b in (b.slice(i, j - i) for b in batches for i, j in steps(b.column(1))):
            lens, best = windows(b.column(1), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens.astype(np.int32)), pa.array(best, mask=np.isnan(best))], names=[id_col, "clean_length", "prob"])

    out = rows.mapInArrow(run, T.StructType([rows.schema.fields[0], T.StructField("clean_length", T.IntegerType()), T.StructField("prob", T.DoubleType())]))
    status = F.when(F.col("clean_length") == 0, "empty_after_cleaning").when(F.col("clean_length") < 6, "shorter_than_6").otherwise("ok")
    return out.withColumns({"label": labels.label(F.col("prob"), threshold), "status": status})


def code_counts(records: DataFrame, text_col: str = "sequence") -> DataFrame:
    """code, n: how often each six-mer stands in all texts. A task adds up its own texts and sends one row a code at most."""

    def run(batches):
        total = np.zeros(SIXMERS, np.int64)
        for b in batches:
            for i, j in steps(b.column(0)):
                total += counts(b.column(0).slice(i, j - i))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["code", "n"])

    return records.select(text_col).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def predict_distinct(spark: SparkSession, records: DataFrame, table: np.ndarray, id_col: str = "id", text_col: str = "sequence") -> DataFrame:
    """Score each distinct sequence once and join back, for inputs with many copies."""
    scored = predict(spark, records.select(F.col(text_col).alias("k")).distinct(), table, "k", "k")
    return records.select(id_col, F.col(text_col).alias("k")).join(scored, "k").drop("k")


def top_hits(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k best; among equals the largest id is chosen, and what was chosen is listed by id."""
    from pyspark.sql import Window

    best = scored.where("status = 'ok'").orderBy(F.desc("prob"), F.desc(id_col)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("prob"), id_col)))


def run_report(scored: DataFrame, id_col: str = "id") -> DataFrame:
    ok = F.col("status") == "ok"
    return scored.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("predicted"), F.count_if(~ok).alias("skipped"), F.count_if(F.col("label") == "AMYLOID").alias("positive"),
        F.avg("prob").alias("mean_prob"), F.max("prob").alias("max_prob"), F.min_by(id_col, F.when(ok, F.struct(-F.col("prob"), F.col(id_col)))).alias("max_id"),
    )


def near_threshold(a: Column, b: Column, at: float = 0.5, within: float = 0.01) -> Column:
    return (F.abs(a - at) <= within) | (F.abs(b - at) <= within)


# tabulation of a forest over all six-mers


def sixmer_digits() -> np.ndarray:
    codes = np.arange(SIXMERS)
    return np.stack([codes // 6 ** (5 - k) % 6 for k in range(6)], 1)


def multigrams() -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(digits, gaps between them) of the 6 single, 4 x 36 paired and 3 x 216 triple features."""
    singles = [((a,), ()) for a in range(6)]
    pairs = [((a, b), (g,)) for g in range(4) for a in range(6) for b in range(6)]
    return singles + pairs + [((a, b, c), g) for g in ((0, 0), (0, 1), (1, 0)) for a in range(6) for b in range(6) for c in range(6)]


def feature_matrix(features: list[tuple[tuple[int, ...], tuple[int, ...]]], digits: np.ndarray) -> np.ndarray:
    """Whether each six-mer holds each feature anywhere."""
    out = np.zeros((len(digits), len(features)), bool)
    for j, (letters, gaps) in enumerate(features):
        at = np.cumsum([0, *(g + 1 for g in gaps)])
        for start in range(6 - at[-1]):
            out[:, j] |= np.all([digits[:, start + at[k]] == x for k, x in enumerate(letters)], axis=0)
    return out


def forest_probability(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Mean share of the second class over trees given as arrays left, right, feature, split, counts; <= goes left, a node without children is a leaf."""
    total = np.zeros(len(x))
    for t in trees:
        left, right, feature, split = (np.asarray(t[k]) for k in ("left", "right", "feature", "split"))
        counts = np.asarray(t["counts"], float)
        node = np.zeros(len(x), int)
        while (inner := (left[node] != 0) | (right[node] != 0)).any():
            down = x[np.arange(len(x)), feature[node]] <= split[node]
            node = np.where(inner, np.where(down, left[node], right[node]), node)
        sums = counts[node].sum(1)
        total += np.divide(counts[node][:, 1], sums, out=np.zeros(len(x)), where=sums > 0)
    return total / max(len(trees), 1)
