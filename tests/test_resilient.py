"""Failing records, finished chunks and keyed streams."""

import numpy as np
import pyarrow as pa
import pytest
from burdock.operators import resilient, scoring
from burdock.streaming import scoring as stream
from pyspark.sql import functions as F

SCHEMA = "id string, sequence string"


def _double(batch):
    v = batch.column(0).to_pylist()
    if any(x is None or x < 0 for x in v):
        raise ValueError(f"bad {next(x for x in v if x is None or x < 0)}")
    return pa.RecordBatch.from_arrays([pa.array([2 * x for x in v])], names=["y"])


def test_halves_find_the_failing_records():
    calls = []

    def fn(batch):
        calls.append(batch.num_rows)
        return _double(batch)

    values = [*range(500), -1, *range(300), None, *range(223)]
    out = list(resilient.isolated(pa.RecordBatch.from_arrays([pa.array(values)], names=["x"]), fn))
    assert [x for piece, _, _ in out for x in piece.column(0).to_pylist()] == values  # in order, each once
    assert [(p.column(0).to_pylist(), e) for p, o, e in out if o is None] == [([-1], "ValueError: bad -1"), ([None], "ValueError: bad None")]
    assert [y for _, o, _ in out if o is not None for y in o.column(0).to_pylist()] == [2 * x for x in values if x is not None and x >= 0]
    assert len(calls) < 60
    assert list(resilient.isolated(pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["x"]), fn))[0][1].num_rows == 0


def test_one_bad_record_leaves_the_others(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 617, -5).otherwise(F.col("id")).alias("x"), (F.col("id") + 10_000).alias("k")).coalesce(1)
    got = {r.k: r for r in resilient.apply_isolated(df, _double, ["k"], "y long").collect()}
    assert len(got) == 1000 and got[10_617].y is None and got[10_617].error == "ValueError: bad -5"
    assert all(r.y == 2 * (k - 10_000) and r.error is None for k, r in got.items() if k != 10_617)
    few = resilient.apply_isolated(df, lambda b: b.slice(0, 0).rename_columns(["y", "z"]).select(["y"]), ["k"], "y long").where("error is null")
    assert few.count() == 0  # a step that loses rows is found out
    rows = spark.createDataFrame([("a", "VQIVYK"), ("b", "AC"), ("c", None)], SCHEMA).coalesce(1)
    got = {r.id: (r.prob is not None, r.error) for r in resilient.predict_isolated(spark, rows, scoring.surrogate_table()).collect()}
    assert got == {"a": (True, None), "b": (False, "ValueError: 2 residues, 6 are needed"), "c": (False, "ValueError: 0 residues, 6 are needed")}


def test_chunks_are_kept_checked_and_done_anew(spark, tmp_path):
    out, table = str(tmp_path / "out"), scoring.surrogate_table()
    rows = spark.createDataFrame([(f"r{i}", "VQIVYK" + "ACDEFG"[i % 6] * (i % 5)) for i in range(200)] + [("r1", "VQIVYKA")], SCHEMA)
    first = resilient.score_chunks(spark, rows, out, table, 8)
    assert {r.state for r in first.collect()} == {"DONE"} and first.agg(F.sum("n")).first()[0] == 200
    assert {r.state for r in resilient.score_chunks(spark, rows, out, table, 8).collect()} == {"SKIPPED"}
    want = sorted(map(tuple, spark.read.parquet(out).select("id", "prob").collect()))
    assert len(want) == 200
    folders = sorted(tmp_path.glob("out/chunk=*"))
    files = sorted(folders[2].glob("*.parquet"))
    short = spark.read.parquet(str(files[0])).limit(3).collect()
    spark.createDataFrame(short, spark.read.parquet(str(files[0])).schema).coalesce(1).write.mode("overwrite").parquet(str(folders[2]))  # a chunk with too few rows
    twice = spark.read.parquet(str(folders[5])).collect()
    spark.createDataFrame(twice[:-1] + twice[:1], spark.read.parquet(str(folders[5])).schema).write.mode("overwrite").parquet(str(folders[5]))  # as many rows, one of them twice
    states = {r.chunk: r.state for r in resilient.score_chunks(spark, rows, out, table, 8).collect()}
    names = [int(f.name.split("=")[1]) for f in folders]
    assert {c for c, s in states.items() if s == "DONE"} == {names[2], names[5]} and set(states.values()) == {"DONE", "SKIPPED"}
    assert sorted(map(tuple, spark.read.parquet(out).select("id", "prob").collect())) == want
    more = rows.unionByName(spark.createDataFrame([("new", "VQIVYK")], SCHEMA))
    assert sorted(r.state for r in resilient.score_chunks(spark, more, out, table, 8).collect()) == ["DONE"] + ["SKIPPED"] * 7


def _land(spark, at, lo, hi):
    spark.createDataFrame([(f"r{i}", "VQIVYKACD") for i in range(lo, hi)], SCHEMA).coalesce(1).write.mode("append").parquet(at)


def test_a_stopped_stream_gives_each_record_once(spark, tmp_path, monkeypatch):
    land, out, check, table = (str(tmp_path / x) for x in ("in", "out", "check", "t"))
    table = scoring.surrogate_table()
    go = lambda: stream.score_keyed(spark, land, SCHEMA, out, check, table, files=1)
    for lo, hi in ((0, 10), (5, 20), (15, 30)):  # files share ids
        _land(spark, land, lo, hi)
    plain, seen = stream.scoring.predict, []

    def failing(*args, **kw):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("the executor is lost")
        return plain(*args, **kw)

    monkeypatch.setattr(stream.scoring, "predict", failing)
    query = go()
    with pytest.raises(Exception, match="the executor is lost"):
        query.awaitTermination(120)
    held = stream.keyed_results(spark, out)
    assert 0 < held.count() < 30
    monkeypatch.setattr(stream.scoring, "predict", plain)
    go().awaitTermination(120)
    ids = sorted(r.id for r in stream.keyed_results(spark, out).collect())
    assert ids == sorted(f"r{i}" for i in range(30))
    _land(spark, land, 28, 33)
    go().awaitTermination(120)
    assert stream.keyed_results(spark, out).count() == 33
    ledger = {r.batch: (r.n, r.valid) for r in stream.keyed_ledger(spark, out).collect()}
    assert len(ledger) == 4 and all(v for _, v in ledger.values()) and sum(n for n, _ in ledger.values()) == 33
    # a batch with wrong rows is done anew
    bad = spark.read.parquet(f"{out}/batch=1").limit(2).collect()
    spark.createDataFrame(bad, spark.read.parquet(f"{out}/batch=1").schema).write.mode("overwrite").parquet(f"{out}/batch=1")
    assert stream.keyed_results(spark, out).count() < 33
    assert stream.mend_keyed(spark, land, SCHEMA, out, table) == ledger[1][0]
    assert sorted(r.id for r in stream.keyed_results(spark, out).collect()) == sorted(f"r{i}" for i in range(33))
    assert stream.mend_keyed(spark, land, SCHEMA, out, table) == 0
    assert np.isfinite([r.prob for r in stream.keyed_results(spark, out).collect()]).all()


def test_table_functions(spark):
    from burdock.functions import register

    assert {"text_windows", "json_leaves", "motif_hits"} <= set(register.register(spark))
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()), key=str)
    assert rows("SELECT * FROM text_windows('abcd', 3)") == [(1, "abc"), (2, "bcd")] and rows("SELECT * FROM text_windows(NULL, 3)") == rows("SELECT * FROM text_windows('ab', 3)") == []
    assert rows("""SELECT * FROM json_leaves('{"a": [1, {"b": 2.50}], "c": null, "d": true, "e": {}}')""") == [("$.a[0]", "1"), ("$.a[1].b", "2.50"), ("$.c", None), ("$.d", "true")]
    assert rows("SELECT * FROM json_leaves('not json')") == rows("SELECT * FROM json_leaves(NULL)") == []
    assert rows("SELECT * FROM motif_hits('mKVkvK', 'KV,V.')") == [("KV", 2, "KV"), ("KV", 4, "kv"), ("V.", 3, "Vk"), ("V.", 5, "vK")]
