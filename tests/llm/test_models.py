"""Language spans, license scans, token counts and neighbours, against brute force or held-out truth."""

import zlib

import numpy as np
import pytest
from burdock.llm import ann, langid, license, tokens
from burdock.llm import queries as llm

# languages


def test_languages_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = llm.QUERIES["op7_language_spans"](spark, sf).collect()
    assert len(rows) == 1000 and {r.lang_pred for r in rows} <= {*truth.values(), "und"} and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def best_path(scores, penalty):
    """All paths of a short sequence."""
    import itertools

    total = lambda p: sum(scores[t][x] for t, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))
    return max(map(total, itertools.product(range(scores.shape[1]), repeat=len(scores)))), total


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    lens = np.array([0, 5, 1, 6, 0, 3])
    scores = rng.normal(size=(lens.sum(), 3)).astype(np.float32)
    labels, at = langid.viterbi(scores, lens, 0.7), 0
    for n in lens:
        if n:
            most, total = best_path(scores[at : at + n], 0.7)
            assert total(labels[at : at + n]) == pytest.approx(most, abs=1e-5)
        at += n


def test_spans_of_mixed_texts_and_odd_rows(spark, odd, empty):
    en, ru = "the cat and the dog are here now " * 30, "кошка и собака теперь здесь дома " * 30
    rows = [(1, en, "en", 0), (2, ru, "ru", 0), (3, "der hund und die katze sind jetzt hier " * 30, "de", 0), (4, None, "en", 0), (5, "x", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = langid.train(docs)
    got = langid.label(m, ["the cat and the dog are here " * 3 + "der hund und die katze sind " * 3, "кошка the здесь", None, "12 34", "日本語", ""])
    assert [s[2] for s in got[0][2]] == ["en", "de"] and got[0][2][0][1] == 20
    assert got[1][0] == "ru" and [g[0] for g in got[2:4]] == ["und", "und"] and got[4][0] in m["langs"] and got[5] == ("und", 0.0, [])
    assert langid.predict(odd, m).count() == odd.count() and langid.predict(empty, m).count() == 0
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_labels_of_many_languages():
    """Labels are numbers of any size: 200 languages, each with a letter run of its own."""
    names = [f"l{i:03d}" for i in range(200)]
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) * 3
    m = langid.model({n: langid.counts([f"{word(7 * i)} " * 40]) for i, n in enumerate(names)})
    for i in (0, 126, 127, 128, 129, 199):
        got = langid.label(m, [f"{word(7 * i)} " * 12])[0]
        assert got[0] == names[i] and got[2] == [(0, 11, names[i])]


def test_grams_and_model_equal_plain_loops():
    texts = ["Die Katze und der Hund", "x é", "", "кот"]

    def bucket(g):
        h = 0
        for c in g:
            h = ((h ^ c) * 0x01000193) % 2**32
        return (h ^ h >> 15) % langid.BUCKETS

    want = np.zeros(langid.SIZE, np.int64)
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).encode().split():
            w = b" " + w + b" "
            for k, n in enumerate(langid.ORDERS):
                for i in range(len(w) - n + 1):
                    want[k * langid.BUCKETS + bucket(w[i : i + n])] += 1
    assert (langid.counts(texts)[: 2 * langid.BUCKETS] == want[: 2 * langid.BUCKETS]).all()
    m = langid.model({"a": langid.counts(texts[:1]), "b": langid.counts(texts[3:])})
    raw = [[np.log((c + 0.5) / (n + 0.5 * langid.BUCKETS)) for c, n in zip(row, np.sum([langid.counts(texts[:1])[: langid.BUCKETS], langid.counts(texts[3:])[: langid.BUCKETS]], 1), strict=True)] for row in zip(langid.counts(texts[:1])[:50], langid.counts(texts[3:])[:50], strict=True)]
    assert np.allclose(m["logs"][0][:50], [[(v - sum(r) / 2) / 2 for v in r] for r in raw], atol=1e-5)


# licenses


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_planted_licenses_are_found_with_their_spans(spark, odd, empty):
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join("".join(rng.choice(list("abcdeéz"), 5)) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(license.TEMPLATES.items()):
        w = text.split()
        if len(w) > 20:
            w[7], w[15:16] = "changed", []
        head = filler(30)
        body = " ".join(w)
        rows.append((i, f"{head}\n{body}\n{filler(20)} {text}", 0))
        want.add((i, name, 0, len(head) + 1))
    docs = spark.createDataFrame([*rows, (99, filler(200), 0)], "doc_id long, text string, template int")
    got = license.scan(docs).collect()
    assert all(r.coverage >= 0.7 for r in got) and 99 not in {r.doc_id for r in got}
    for i, name, k, start in want:
        own = [r for r in got if r.doc_id == i and r.template == name]
        assert len(own) == 2 and own[k].start == start
        assert own[1].coverage == 1 and rows[i][1][own[1].start : own[1].end] in license.TEMPLATES[name]
    assert license.scan(odd).count() == 0 and license.scan(empty).count() == 0


def test_adjacent_short_notices_are_all_found(spark):
    rng = np.random.default_rng(12)
    short = {"MIT-line": license.TEMPLATES["MIT-line"], "CC-BY-NC-4.0-line": license.TEMPLATES["CC-BY-NC-4.0-line"], "three": "provided as is"}
    texts = ["\n".join([short["MIT-line"]] * 100), "\n".join([short["CC-BY-NC-4.0-line"]] * 2)]
    for _ in range(30):  # copies with up to seven words between them
        parts = [p for _ in range(rng.integers(2, 30)) for p in (*["qq"] * int(rng.integers(0, 8)), short[str(rng.choice(list(short)))])]
        texts.append(" ".join(parts))
    want = []
    for i, text in enumerate(texts):
        for name, t in short.items():
            at, k = text.find(t), 0
            while at >= 0:
                want.append((i, name, k, at, at + len(t.rstrip("."))))
                at, k = text.find(t, at + len(t)), k + 1
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), short, least=1.0).collect()
    assert sorted((r.doc_id, r.template, r.occurrence, r.start, r.end) for r in got) == sorted(want)
    loose = [r for r in license.scan(spark.createDataFrame([(0, texts[0])], "doc_id long, text string")).collect() if r.template == "MIT-line"]
    assert len(loose) == 100 and {r.coverage for r in loose} == {1.0}


def banded(a, b, low, high):
    """Longest common subsequence of pairs (i, j) with low <= i - j <= high, by the plain table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + 1 if x == y and low <= i - j <= high else 0)
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(4))
def test_matches_are_those_of_all_alignments(seed):
    """On random texts with edited copies: each match is worth what it says, matches of a template are apart, and around
    no run of four template words an alignment on free words is left that covers enough. No document is skipped."""
    rng = np.random.default_rng(seed)
    draw = lambda n, k: [f"w{i}" for i in rng.integers(0, k, n)]
    for _ in range(40):
        table = {f"t{i}": " ".join(draw(rng.integers(4, 22), 12)) for i in range(3)}
        text = draw(rng.integers(0, 20), 40)
        for _ in range(rng.integers(1, 5)):
            copy = table[f"t{rng.integers(0, 3)}"].split()
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = "zz"
            text += copy[int(rng.integers(0, 2)) :] + draw(rng.integers(0, 6), 40)
        ws, index, least = license.words(" ".join(text)), license.Index(table), 0.7
        hits = {}
        for (_, t), diagonals in index.candidates(*license.word_hashes([ws])).items():
            hits[t] = diagonals
        got = license.matches(index, ws, hits, least)
        for t, template in enumerate(index.words):
            own = [g for g in got if g[0] == t]
            free = [True] * len(ws)
            for _, n, first, last in own:
                assert n >= least * len(template) and n <= plain_lcs(ws[first : last + 1], template)
                assert all(free[first : last + 1])
                free[first : last + 1] = [False] * (last + 1 - first)
            runs = [(i, j) for i in range(len(ws) - 3) for j in range(len(template) - 3) if ws[i : i + 4] == template[j : j + 4]]
            for i, j in runs:
                d, edge = i - j, [k for k in range(len(ws) + 1) if k == len(ws) or not free[k]]
                start = max([0, *(k + 1 for k in edge if k < i)])
                stop = min([k for k in edge if k >= i])
                if free[i]:
                    assert banded(ws[start:stop], template, d - license.BAND - start, d + license.BAND - start) < least * len(template), (ws, template, own)


def test_templates_come_from_a_table(spark):
    rows = spark.createDataFrame([("a", "one two three four five"), ("a", "zz"), (None, "x y z"), ("b", None)], "name string, text string")
    assert license.templates(rows) == {"a": "one two three four five"}
    docs = spark.createDataFrame([(1, "so: One two three, four five!")], "doc_id long, text string")
    assert [(r.template, r.matched_words, r.start, r.end) for r in license.scan(docs, rows).collect()] == [("a", 5, 4, 28)]
    assert all(len(t.split()) > 3 for t in license.TEMPLATES.values())


def test_families_are_told_apart(spark):
    names = ["AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "LGPL-3.0-or-later", "MIT", "MIT-0", "0BSD", "ISC", "Apache-2.0"]
    rows = [(i, f"some code {license.TEMPLATES[n]} and more") for i, n in enumerate(names)] + [(99, license.TEMPLATES["MIT"] + " x " * 9 + license.TEMPLATES["LGPL-3.0-or-later"])]
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    best = {i: [r.template for r in got if r.doc_id == i and r.best] for i, _ in rows}
    assert {i: best[i] for i in range(len(names))} == {i: [n] for i, n in enumerate(names)} and sorted(best[99]) == ["LGPL-3.0-or-later", "MIT"]
    lesser = {r.template: r for r in got if r.doc_id == names.index("LGPL-3.0-or-later")}
    assert lesser["LGPL-3.0-or-later"].share == 1 > lesser["GPL-3.0-or-later"].share and not lesser["GPL-3.0-or-later"].best and lesser["GPL-3.0-or-later"].coverage == 1


def test_common_phrases_are_not_aligned():
    index, calls, plain = license.Index(license.TEMPLATES), [], license.align
    text = license.words("the software is provided as is without warranty of any kind " * 2000)
    ws = {t: d for (_, t), d in index.candidates(*license.word_hashes([text])).items()}
    license.align = lambda *a: calls.append(1) or plain(*a)
    try:
        assert license.matches(index, text, ws, 0.7) == []
    finally:
        license.align = plain
    assert not calls
    rng = np.random.default_rng(1)
    for _ in range(300):
        words = rng.integers(0, 12, rng.integers(5, 40)).tolist()
        text = [str(w).encode() for w in rng.integers(0, 15, 60)]
        one = license.Index({"t": " ".join(map(str, words))})
        n = license.align(text, one.words[0], -60, 60)[0]
        assert n <= one.most(0, one.numbers(text)) <= len(words)


def test_a_model_of_few_of_many_languages(spark, monkeypatch):
    rows = [(f"{'abcd'[i % 4] * 3} word {'abcd'[i % 4]}x", "abcd"[i % 4]) for i in range(80)] + [("odd text", f"odd{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(langid, "HELD_LANGS", 2)
    m = langid.train(df, max_langs=4)
    assert m["langs"] == ["a", "b", "c", "d"]
    whole = langid.train(df.where("length(lang) = 1"))
    assert all((x == y).all() for x, y in zip(m["logs"], whole["logs"], strict=True))


def test_license_lines_of_the_corpus(spark, docs, sf):
    got = {(r.doc_id, r.template) for r in llm.QUERIES["op1_license_scan"](spark, sf).collect()}
    for name in ("Apache-2.0-line", "MIT-line", "GPL-3.0-line", "CC-BY-NC-4.0-line"):
        assert {r.doc_id for r in docs.collect() if license.TEMPLATES[name] in r.text} <= {d for d, n in got if n == name}


def test_band_wide_enough_gives_the_longest_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = ([bytes([c]) for c in rng.integers(97, 101, rng.integers(1, 14))] for _ in range(2))
        assert license.align(a, b, -20, 20)[0] == plain_lcs(a, b)


# token counts


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_sections_share_out_every_token(spark, docs, rule):
    enc, size = tokens.encoding(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    got = {}
    for r in tokens.count(docs.limit(60), rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in docs.limit(60).collect():
        ids, rows = enc.encode_ordinary(d.text), sorted(got[d.doc_id], key=lambda r: r.section)
        lines = d.text.splitlines(keepends=True) if "\r" not in d.text else None
        bounds, at = [], 0
        for line in d.text.split("\n"):
            bounds.append((at, min(at + len(line) + 1, len(d.text))))
            at += len(line) + 1
        bounds = [b for b in bounds if b[0] < b[1]] or [(0, 0)]
        assert [(r.start, r.end) for r in rows] == bounds and lines
        want, byte = [0] * len(rows), 0
        edges = [(len(d.text[:a].encode()), len(d.text[:b].encode())) for a, b in bounds]
        for n in size[ids].tolist():
            inside = [max(0, min(byte + n, b) - max(byte, a)) for a, b in edges]
            hit = [k for k, x in enumerate(inside) if x]
            want[hit[0] if rule == "first" else hit[-1] if rule == "last" else inside.index(max(inside))] += 1
            byte += n
        assert [r.n_tokens for r in rows] == want and {r.doc_tokens for r in rows} == {len(ids)}


def test_token_counts_of_odd_rows(spark, odd, empty):
    rows = tokens.count(odd, sections="block", rule="most").collect()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0} and {r.doc_id for r in rows} == {1, 2, 3, None, 5, 6, 7}
    assert tokens.count(empty).count() == 0


# neighbours


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        s = [(-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x)]
        out[q] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


def check(got, want):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {q for q in want if want[q]}
    for q, rows in by.items():
        assert [i for i, _ in rows] == [i for i, _ in want[q]] and np.allclose([s for _, s in rows], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def test_neighbours_equal_brute_force(spark, sf, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    check(llm.QUERIES["op10_block_neighbours"](spark, sf).collect(), want)
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "GROUP", 7)
    check(llm.QUERIES["op10_block_neighbours"](spark, sf).collect(), want)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [2.0, 1.0]), (40, [1.0, 0.0, 0.0]), (21, [5.0, 5.0]), (22, [5.0, 5.0]), (23, [-1e-30, 1e-30])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    fit = [r for r in rows if r[0] in (0, 7, 20, 40, 21, 22, 23)]
    check(ann.search(spark, df.where("vec_id % 20 = 0"), df, 20).collect(), brute(fit, [r for r in fit if r[0] % 20 == 0], 20))
    assert ann.search(spark, df.limit(0), df, 20).count() == 0 and ann.search(spark, df, df.limit(0), 20).count() == 0


def test_neighbours_equal_their_sql(spark, sf):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(ann.ORACLE).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    got = llm.QUERIES["op10_block_neighbours"](spark, sf).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert got[want.columns].values.tolist() == want.values.tolist()


def test_neighbours_keep_doubles(spark):
    """Vectors that are the same as floats are told apart, and scores are those of the doubles."""
    rows = [(20, [0.1, 1.0]), (1, [0.1, 1.0]), (2, [0.1 + 1e-10, 1.0]), (3, [1e300, 1.0]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.rank, r.score) for r in ann.search(spark, df.where("vec_id = 20"), df).collect()}
    assert [out[i][0] for i in (3, 2, 1, 4)] == [1, 2, 3, 4]
    assert out[1][1] == 0.1 * 0.1 + 1.0 and out[2][1] == 0.1 * (0.1 + 1e-10) + 1.0 and out[3][1] == 0.1 * 1e300 + 1.0


def test_products_of_many_dimensions_are_exact(spark):
    rng = np.random.default_rng(11)
    a, b = (rng.integers(100, 128, (3, 4096)).astype(np.int8) for _ in range(2))
    assert (ann.product(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    x = rng.uniform(0.99, 1.0, (60, 4096)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(spark, df.where("vec_id % 20 = 0"), df, 5).collect()
    real = x.astype(float) @ x.T.astype(float)
    for q in (0, 20, 40):
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-real[q, i], i))[:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_quantisation_bound_holds():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(50, 64)) * rng.uniform(0.01, 100, (50, 1))).astype(np.float32)
    codes, (scale, norm, near, gap) = ann.quantise(x)
    real, est = x.astype(float) @ x.T.astype(float), (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(real - est) <= near[:, None] * gap + gap[:, None] * norm + 1e-9).all()
