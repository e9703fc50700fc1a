"""The corpus pipeline: quality classifier, near-duplicate join, decontamination, secret scan, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burdock.llm import common, decontam, ngram_join, packing, quality, secrets

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", ngram_join.stage),
    ("decontamination", decontam.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]
#: No SQL for the classifier, the tokenizer or components of a similarity graph.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's own tables go when its result is written, a result when the next one is. Each stage states what it does
    with nulls, empty and long texts, repeated rows and extra columns; an empty table passes through as an empty one.
    """
    ws, before = common.Workspace(spark), None
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.passing():
            docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
