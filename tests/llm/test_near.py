"""The n-gram join and the pipeline against brute force."""

import re

import corpus_pipeline
import numpy as np
import pytest
from burdock.llm import common, ngram_join, packing, secrets
from burdock.llm import queries as llm
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_components(docs, k=4, num=85, den=100):
    """{row: (size, component)} over all pairs that share a shingle."""
    sets = [plain_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    shared = {}
    for own in by.values():
        for x, i in enumerate(own):
            for j in own[x + 1 :]:
                shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), n in shared.items():
        if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def got(df):
    return sorted(((r.id, r.n, r.component) for r in df.collect()), key=str)


def test_join_equals_all_pairs(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = llm.QUERIES["op6_ngram_jaccard"](spark, f"/root/testdata/{sf}").collect()
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == plain_components(docs)


@pytest.mark.parametrize("seed", range(3))
def test_join_on_edited_copies(spark, seed, monkeypatch):
    """Families of edited copies around the threshold, a passage in every document, chains, short and odd rows."""
    monkeypatch.setattr(ngram_join, "FLUSH", 500)
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 3))
    passage = [word() for _ in range(12)]
    texts = [None, "", " \n", "one", "One", "one two", "one two three four", "one two three four five", "é É x y", "É É x y"]
    for _ in range(12):
        base = [word() for _ in range(rng.integers(4, 90))]
        for _ in range(rng.integers(1, 12)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[rng.integers(0, 6) :]
            if rng.random() < 0.5:
                copy += passage
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    docs = [(None if rng.random() < 0.05 else int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs += [docs[20], docs[20], (docs[25][0], docs[26][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(5)
    for k, num in ((4, 85), (2, 60)):
        assert got(ngram_join.join_components(spark, df, k, num, 100, buckets=16)) == plain_components(docs, k, num)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(150, 149)] + [(7, 7)]
    out = ngram_join.components(common.Workspace(spark), spark.createDataFrame(edges, "a long, b long"), "t").distinct().collect()
    assert {(r.node, r.root) for r in out} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 151)}


def test_join_of_empty_and_odd_tables(spark, odd, empty):
    assert ngram_join.join_components(spark, empty).count() == 0
    assert got(ngram_join.join_components(spark, odd)) == plain_components([(r.doc_id, r.text) for r in odd.collect()])


def test_stage_keeps_one_of_each_group(spark, odd, docs, sf):
    out = ngram_join.stage(spark, docs, sf)
    want = {c for d, n, c in plain_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if n} | {r.doc_id for r in docs.collect() if not plain_set(r.text, 5)}
    assert out.schema == docs.schema and {r.doc_id for r in out.collect()} == want
    kept = ngram_join.stage(spark, odd, sf)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None"] and kept.columns == odd.columns


def test_stage_tells_rows_of_one_id_apart(spark):
    """A text that shares its id with a copy stays; of a group without ids one row stays."""
    w = [f"w{i}" for i in range(60)]
    text, other, third = " ".join(w), " ".join(f"v{i}" for i in range(40)), " ".join(f"z{i}" for i in range(30))
    rows = [(1, text), (2, text + " more"), (2, other), (3, other + " b c"), (None, third), (None, third), (None, third + " x"), (None, "alone here"), (4, ""), (4, ""), (5, text), (1, text)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, __n int").withColumnRenamed("__n", "n")
    out = sorted(((r.doc_id, r.text) for r in ngram_join.stage(spark, df, "").collect()), key=str)
    assert [r for r in out if r[0]] == [(1, text), (2, other), (4, ""), (4, "")]
    assert len([r for r in out if r[0] is None]) == 2 and (None, "alone here") in out


def test_orders_cut_pairs_before_sets_are_joined(spark):
    """Texts of 12 of 24 stock passages: nearly all pairs share passages, hardly any links. Pairs that reach the whole
    sets grow with the texts, not with their square; and the result is that of all pairs."""
    rng = np.random.default_rng(1)
    stock = [" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(40)) for _ in range(24)]
    texts = [" ".join(stock[j] for j in sorted(rng.choice(24, 12, replace=False))) for _ in range(240)]
    docs = list(enumerate([*texts, *(t + " end" for t in texts[:30])]))
    seen = []
    out = ngram_join.join_components(spark, spark.createDataFrame(docs, "doc_id long, text string"), seen=seen)
    assert got(out) == plain_components(docs)
    assert all(x["pairs"] >= x["sketch"] >= x["order_2"] >= x["order_3"] for x in seen)
    assert sum(x["order_3"] for x in seen) < 2 * len(docs)


def test_sketch_and_prefixes_lose_no_link():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 85 * (len(a) + len(b) - both):
            continue
        apart = sum(int(x).bit_count() for x in (ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64))
        assert apart <= len(a) + len(b) - 2 * both
        for salt in ngram_join.SALTS:
            assert set(ngram_join.prefix(a, salt, 85, 100).tolist()) & set(ngram_join.prefix(b, salt, 85, 100).tolist())


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, sf, tmp_path):
    import shutil

    for name, rows in (("odd", odd), ("empty", empty)):
        at = tmp_path / name
        at.mkdir()
        for table in ("labels", "benchmark"):  # contents alone: the folder of the test data may be read-only
            shutil.copyfile(f"{sf}/{table}.parquet", at / f"{table}.parquet")
        rows.write.parquet(str(at / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(at)).collect()
        assert (out == []) == (name == "empty")
        assert {r.doc_id for r in out} <= {1, 2, 3, None, 5, 6, 7}


def test_pipeline(spark, sf):
    """Each stage's decisions hold in what the next one gets."""
    from .test_documents import check_pieces, plain_hits, plain_spans

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(spark.createDataFrame(stage(spark, steps[-1], sf).collect(), docs.schema))
    q, n, c, s = ({r.doc_id: r for r in x.collect()} for x in steps[1:])
    keep = {r.doc_id for r in llm.QUERIES["op3_quality_fm"](spark, sf).where(F.col("score") >= 0.3).collect()}
    assert set(q) == keep
    assert set(n) == {x for _, size, x in plain_components([(r.doc_id, r.text) for r in q.values()], 5, 80)}
    hits = {d: plain_hits(r.text, items) for d, r in n.items()}
    assert set(c) == {d for d, h in hits.items() if not (h[1] and 20 * h[1] >= h[0])} == set(s)
    assert all(plain_spans(r.text) == [] for r in s.values())
    enc = packing.Encoder(packing.tokenizer_path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(s)
    check_pieces(rows, lambda d: [*enc(s[d].text).tolist(), 2])
    assert secrets.KINDS
