"""Every query with SQL against DuckDB on the smallest tables."""

import pathlib

import duckdb
import pandas as pd
import pytest
from burdock.operators import cohort
from burdock.plans import registry

QUERIES, ORACLES = registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(df):
    cell = lambda v: None if pd.isna(v) else float(v) + 0.0 if isinstance(v, float) or hasattr(v, "dtype") else v
    return sorted(str(tuple(float(c) if isinstance(c, int) and not isinstance(c, bool) else c for c in map(cell, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


#: Queries that SQL cannot repeat, and the test that holds their operator against plain loops.
TESTED = {
    "p_values": "test_distributions_against_direct_sums", "ols_p_values": "test_permutation_and_ols", "random_sets": "test_random_sets_against_a_plain_loop",
    "bootstrap_ci": "test_blocks_of_resamples", "bootstrap_effects": "test_bootstrapped_effects_and_random_sets", "bootstrap_coupling": "test_bootstrapped_effects_and_random_sets",
    "within_bin_permutation": "test_blocks_of_resamples", "counterfactual_null": "test_counterfactual_null_against_a_plain_loop", "gene_set_variation": "test_enrichment_against_running_sums",
    "enrichment_test": "test_enrichment_against_running_sums", "matched_controls": "test_matching_equals_the_plain_loop", "downsample_per_class": "test_down_samples_are_whole_and_repeatable",
    "stacked_ensemble": "test_stack_of_members_and_folds",
}


def test_every_query_has_sql_or_a_test():
    named = "".join(p.read_text() for p in pathlib.Path(__file__).parent.glob("*.py"))
    assert set(TESTED) == set(QUERIES) - set(ORACLES)
    assert all(f"def {t}(" in named for t in TESTED.values())


def test_down_samples_are_whole_and_repeatable(spark):
    rows = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(200)], "i int, c string")
    got = sorted((r.i, r.c) for r in cohort.sample_per_class(rows, "c", 30, "i").collect())
    assert got == sorted((r.i, r.c) for r in cohort.sample_per_class(rows.repartition(7), "c", 30, "i").collect())
    sizes = {c: sum(x == c for _, x in got) for c in "abc"}
    assert sizes == {"a": 29, "b": 29, "c": 30} and len({i for i, _ in got}) == len(got)
    assert got != sorted((r.i, r.c) for r in cohort.sample_per_class(rows, "c", 30, "i", seed=18).collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
