"""Line frequency, hard negatives and fill-in-middle against plain loops and SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from burdock.llm import fim, hard_negatives, quality_rules
from hypothesis import given, settings
from hypothesis import strategies as st

QUERIES = {"op11": quality_rules, "op12": hard_negatives, "op13": fim}


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(QUERIES[name].ORACLE).df()
    got = getattr(QUERIES[name], name)(spark, sf).toPandas()
    assert sorted(got) == sorted(want) and len(got) == len(want) > 0
    rows = lambda d: sorted(map(str, d[sorted(d)].astype(object).where(d[sorted(d)].notna(), None).itertuples(index=False, name=None)))
    assert [re.sub(r"\.0\b", "", x) for x in rows(got)] == [re.sub(r"\.0\b", "", x) for x in rows(want)]


# fill-in-middle


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\v\x85aß<PSM>\U0001f600", max_size=60), st.integers(-9, 999))
def test_fim_gives_texts_back(text, key):
    for spm in (0, 100):
        n, form, a, b, out = fim.rearranged(text, str(key), 42, 100, spm)
        assert fim.restored(out, form) == text
        assert n == len(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text))
        marked = not text or any(m in text for m in ("<P>", "<S>", "<M>"))
        assert form == ("plain" if marked else "spm" if spm else "psm")
        assert (a is None) == (b is None) == marked


def test_fim_cuts_where_the_digest_says():
    text, key = "one two  three\nfour ", "7"
    h = [int(hashlib.sha256(b"42:7").hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    parts = ["one", " two", "  three", "\nfour", " "]
    i, j = sorted((h[0] % 6, h[1] % 6))
    n, form, a, b, out = fim.rearranged(text, key, 42, 100, 0)
    assert (n, form, a, b) == (5, "psm", len("".join(parts[:i])), len("".join(parts[i:j])))
    assert out == "<P>" + "".join(parts[:i]) + "<S>" + "".join(parts[j:]) + "<M>" + "".join(parts[i:j])


def test_fim_of_odd_and_empty_tables(spark, odd, empty):
    held = fim.transform(odd, percent=100).toPandas()
    assert len(held) == 8 and held.columns.tolist() == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert held["n"].tolist() == [0, 0, 1, 6, 28, 28, held["n"][6], 30001]  # white space at the end is a unit of its own
    back = fim.transform(odd, percent=100).select(fim.restore("output", "form").alias("t")).toPandas()["t"].tolist()
    assert back == [r.text or "" for r in odd.select("text").collect()]
    assert fim.transform(empty).count() == 0
    twice = held[held["doc_id"] == 5]
    assert twice.iloc[0].equals(twice.iloc[1].rename(twice.index[0]))
    with pytest.raises(ValueError):
        fim.restored("no mark", "psm")


# line frequency


def _verdicts(rows, limit, share):
    """id, removed words and verdict of each row, by plain loops."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda x: " ".join(words(re.sub("[0-9]+", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x))))
    holders = defaultdict(set)
    for i, (key, host, text) in enumerate(rows):
        for x in (text or "").split("\n"):
            if words(x):
                holders[host, norm(x)].add(("row", host, text) if key is None else key)
    out = []
    for key, host, text in rows:
        w = words(text or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {p for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
        gone = sum(len(words(x)) for x in (text or "").split("\n") if words(x) and len(holders[host, norm(x)]) > limit)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((key, len(w), len(hit), gone, failed, not failed and 100 * (len(w) - gone) >= share * len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(3)
    vocabulary = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "prstvxzwyh"]  # no digits: they all count as 0
    common_lines = ["Home  | About", "page 12 of 99", "Subscribe to our newsletter today and never miss a single story again"]
    rows = []
    for i in range(240):
        own = [" ".join(rng.choice(vocabulary, 9)) for _ in range(int(rng.integers(1, 12)))]
        stock = [common_lines[int(rng.integers(3))].replace("12", str(i)) for _ in range(int(rng.integers(0, 9)))]
        host = None if i % 11 == 0 else "big" if i % 3 else f"h{i % 5}"
        rows.append((None if i % 40 == 0 else i // 2 * 2 if i % 50 == 1 else i, host, None if i == 77 else "\n".join([*own, *stock, "", "  "])))
    rows += rows[:6]
    return rows, spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, source string, text string, row long")


@pytest.mark.parametrize("few", [quality_rules.FEW, 0])
def test_line_rule_against_loops(pages, few):
    (rows, df), seen = pages, set()
    for limit, share in ((5, 50), (2, 80)):
        got = quality_rules.judge(df, limit, share, few).select("doc_id", "n_words", "n_repeat_words", "removed_words", "base_failed", "kept").collect()
        want = _verdicts(rows, limit, share)
        assert sorted(map(tuple, got), key=str) == want
        seen |= {x[-1] for x in want}
    assert seen == {True, False}


def test_cleaned_texts(pages):
    rows, df = pages
    got = {r.row: r.text for r in quality_rules.clean(df, 5).collect()}
    verdict = {k: (gone, kept) for k, *_, gone, _, kept in _verdicts(rows, 5, 50) if k is not None}
    assert 0 < len(got) < len(rows)
    for i, (key, _, text) in enumerate(rows):
        if i in got and key is not None and sum(k == key for k, *_ in rows) == 1:
            gone, kept = verdict[key]
            assert kept and len(got[i].split()) == len(text.split()) - gone


def test_one_line_in_every_document_is_met_in_many_places(spark):
    rows = [(i, "hot", "the same line in all of them\n" + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}" for k in range(60))) for i in range(400)]
    held = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    often = quality_rules.frequent(held)
    assert [r.n_docs for r in often.collect()] == [400]
    gone = quality_rules.removals(held, often, few=0)
    assert gone.count() == 400 and "salt" in gone._jdf.queryExecution().optimizedPlan().toString()


def test_line_rule_on_odd_and_empty_tables(odd, empty):
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(odd).collect()}
    assert {(1, 0, True, False), (2, 0, True, False), (3, 0, True, False), (5, 27, True, False), (7, 30000, True, False)} <= got
    assert quality_rules.judge(odd).count() == 8 and quality_rules.judge(empty).count() == 0
    assert quality_rules.clean(empty).columns == empty.columns and quality_rules.clean(odd).columns == odd.columns


# hard negatives


def _mined(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256):
    held = [(i, y, [int(np.floor(scale * float(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in {i for i, _, _ in held if i in anchors}:
        _, label, q = min(r for r in held if r[0] == a)
        near = sorted((-sum(p * x for p, x in zip(q, v, strict=True)), i, y) for i, y, v in held if i != a and len(v) == len(q))
        for ps, p, _ in [r for r in near if r[2] == label][:positives]:
            ok = [(s, i) for s, i, y in near if y != label and low * -ps <= 100 * -s <= high * -ps]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(ok[:negatives])]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, score int, anchor_id string")


def _check(spark, rows, anchors, **kw):
    df = _frame(spark, rows)
    got = hard_negatives.mine(df, df.where(df["vec_id"].isin(sorted(anchors))), **kw)
    want = _mined(rows, anchors, **kw)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_negatives_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(4)), (rng.normal(size=12) * rng.choice([0.2, 1, 5])).tolist()) for i in range(1, 2600)]
    assert len(_check(spark, rows, set(range(100, 2600, 100)))) > 200


def test_negatives_of_equal_odd_and_large_vectors(spark):
    rng = np.random.default_rng(6)
    hot = [0.5, -0.25, 1.0]
    rows = [(i, i % 3, hot if i % 2 else rng.integers(-3, 4, 3).tolist()) for i in range(1, 400)]  # half are one vector: ties
    rows += [(7, 1, [1.0, 1.0, 1.0]), (7, 2, [2.0, 0.0, 0.5]), (400, 1, None), (401, None, hot), (None, 1, hot), (402, 1, [float("nan"), 0.0, 1.0]), (403, 1, [None, 0.0, 1.0]), (404, 0, [1.0, float("inf"), 0.0])]
    rows += [(500 + i, i % 2, [0.5, 0.5]) for i in range(9)] + [(600, 1, [0.0, 0.0, 0.0]), (601, 0, []), (602, 1, [])]
    rows = [(i, y, v and [x if x is None else float(x) for x in v]) for i, y, v in rows]
    assert _check(spark, rows, {7, 8, 9, 100, 403, 502, 600, 601})
    big = [(i, i % 2, [float(int(x)) for x in rng.integers(1, 2**22, 3)]) for i in range(60)]
    assert _check(spark, big, {3, 20}, scale=256)  # sums past 2^53


def test_negatives_without_rows(spark):
    df = _frame(spark, [])
    assert hard_negatives.mine(df, df).count() == 0
    one = _frame(spark, [(1, 1, [1.0, 2.0])])
    assert hard_negatives.mine(one, one).count() == 0
    assert hard_negatives.mine(one, one.where("false")).count() == 0


def test_tree_opens_fewer_leaves_in_an_annulus():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 8)) * 40
    x = np.floor((centres[rng.integers(16, size=2048)] + rng.normal(size=(2048, 8))) * 16)
    tree = hard_negatives.Tree.opened(8, *hard_negatives.Tree.build(np.arange(2048), np.zeros(2048, np.int64), x, 16).packed())
    q = x[5]
    score = x @ q
    high = int(np.partition(score, -900)[-900])
    opened, plain = [], hard_negatives.products
    hard_negatives.products = lambda a, b: opened.append(len(a)) or plain(a, b)
    try:
        windows = hard_negatives.Windows([-float("inf"), high + 1], [high, high], 10)
        tree.search(q, float(q @ q), tree.distances(q, float(q @ q)), np.ones(2048, bool), windows)
    finally:
        hard_negatives.products = plain
    want = sorted((-s, i) for i, s in enumerate(score.tolist()) if s <= high)[:10]
    assert windows.best == [want, []] and sum(opened) < 1400
