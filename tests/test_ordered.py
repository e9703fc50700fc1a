"""Sorted ranges, selection, step-up, random sets and counterfactual permutations against plain loops."""

import numpy as np
import pandas as pd
import pytest
from burdock.functions import special
from burdock.operators import cohort, counterfactual, ordered, stats
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def mixed(spark):
    """Keys of very different sizes, many ties, nulls and a null key."""
    rng = np.random.default_rng(2)
    rows = [("big" if i % 3 else None if i % 2 else f"k{i % 7}", float(x) if i % 11 else None, int(i), bool(rng.integers(2))) for i, x in enumerate(np.round(rng.normal(size=900), 1))]
    rows += [("big", float("nan"), 900, True), ("one", 3.5, 901, False)]
    return pd.DataFrame(rows, columns=["k", "v", "i", "hot"]), spark.createDataFrame(rows, "k string, v double, i int, hot boolean")


def test_ranks_and_quantiles_of_keys_of_any_size(mixed):
    pdf, df = mixed
    pdf = pdf.dropna(subset=["v"]).copy()
    pdf["k"] = pdf["k"].fillna("-")
    pdf["rank"] = pdf.groupby("k")["v"].rank()
    want = {(k, v): (len(g), g["rank"].iloc[0]) for (k, v), g in pdf.groupby(["k", "v"])}
    got = {(r.k or "-", r.v): (r.n, r["rank"]) for r in ordered.value_ranks(df, ["k"], "v").collect()}
    assert got == want
    probs = {"a": 0.0, "b": 0.17, "c": 0.5, "d": 1.0}
    cut = {r.k or "-": [r[c] for c in probs] for r in ordered.quantiles(df, ["k"], "v", probs).collect()}
    for k, g in pdf.groupby("k"):
        assert cut[k] == pytest.approx(np.quantile(g["v"], list(probs.values())))
    whole = ordered.quantiles(df, [], "v", probs).first()
    assert list(whole) == pytest.approx(np.quantile(pdf["v"], list(probs.values())))


def test_places_in_one_total_order(mixed):
    pdf, df = mixed
    got = {r.i: r.at for r in cohort.numbered(df, [F.col("v").asc_nulls_last(), F.col("i")], "at").collect()}
    order = sorted(got, key=lambda i: (pd.isna(pdf["v"][i]) and i != 900, np.inf if i == 900 else np.nan_to_num(pdf["v"][i]), i))
    assert [got[i] for i in order] == list(range(1, len(pdf) + 1))


@pytest.mark.parametrize("values", [[], [1.0], [2.0] * 50, [1e-300, 1e300, -1e308, 1e308, 0.0, 5.0], list(np.random.default_rng(1).exponential(size=4000)), [*np.random.default_rng(1).normal(size=300), *[0.25] * 300]])
def test_selection_by_counts(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "v double")
    got = ordered.select_quantiles(df, "v", {"a": 0.17, "b": 0.5, "c": 1.0}, bins=16)
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.sort(values)
        for k, p in (("a", 0.17), ("b", 0.5), ("c", 1.0)):
            if not values:
                assert got[k] is None
                continue
            h = (len(s) - 1) * p
            assert got[k] == pytest.approx(s[int(h)] + (s[int(np.ceil(h))] - s[int(h)]) * (h - int(h)), rel=1e-12)


def test_step_up_over_all_rows_and_by_key(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], None if i % 9 == 0 else float(np.round(rng.uniform() ** 3, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, p double")

    def plain(ps):
        m, order = len(ps), np.argsort(ps, kind="stable")
        q = np.asarray(ps)[order] * m / np.arange(1, m + 1)
        out = np.empty(m)
        out[order] = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
        return out

    for keys in (None, ["k"]):
        got = {r.i: r.fdr for r in ordered.step_up(df, "p", keys).collect()}
        assert len(got) == 400 and all(got[i] is None for i, _, p in rows if p is None)
        for k in {r[1] for r in rows} if keys else {None}:
            own = [(i, p) for i, kk, p in rows if p is not None and k in (None, kk)]
            assert [got[i] for i, _ in own] == pytest.approx(plain([p for _, p in own]))


def test_competitive_set_and_correlations_in_ranges(mixed):
    pdf, df = mixed
    pdf = pdf.dropna(subset=["v"])
    for keys, frame in ((None, pdf), (["k"], pdf[pdf["k"] == "big"])):
        rows = stats.competitive_set(df, "hot", keys, "v").collect()
        r = next(x for x in rows if not keys or x.k == "big")
        x, y = frame.loc[frame["hot"], "v"].to_numpy(), frame.loc[~frame["hot"], "v"].to_numpy()
        u = ((x[:, None] > y).sum() + (x[:, None] == y).sum() / 2).item()
        assert (r.n_set, r.n_background, r.U) == (len(x), len(y), u) and r.auc == pytest.approx(u / len(x) / len(y))
        assert r.mean_difference == pytest.approx(x.mean() - y.mean())
        assert r.ties == sum(n**3 - n for n in frame["v"].value_counts())
    both = df.withColumn("w", F.round(F.col("v") * F.col("i") % 7, 1))
    r = next(x for x in stats.rank_correlation(both, "v", "w", ["k"]).collect() if x.k == "big")
    own = pd.DataFrame([tuple(x) for x in both.where("k = 'big' and not isnan(v)").select("v", "w").collect()], columns=["v", "w"]).dropna()
    assert r.n == len(own) and r.pearson == pytest.approx(np.corrcoef(own["v"], own["w"])[0, 1]) and r.spearman == pytest.approx(np.corrcoef(own["v"].rank(), own["w"].rank())[0, 1])


def test_no_task_gets_all_rows(mixed):
    _, df = mixed
    plans = [stats.competitive_set(df, "hot", None, "v"), stats.correlation_difference(df.withColumn("w", F.col("v") + 1), "v", "w", "big", "k1", grp="k")]
    for out in plans:
        text = out._jdf.queryExecution().executedPlan().toString()
        for at in [i for i, line in enumerate(text.split("\n")) if "SinglePartition" in line]:
            below = text.split("\n")[at + 1]
            assert "partial" in below or "HashAggregate" in below or "Window" not in below  # totals, not rows


def test_random_sets_against_a_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values, hot = rng.normal(size=240), np.arange(240) % 6 == 0
    values[hot] += 0.12
    df = spark.createDataFrame([(float(v), bool(h)) for v, h in zip(values, hot, strict=True)], "value double, hot boolean")
    monkeypatch.setattr(stats, "SLICE", 9)
    got = stats.random_sets(df, "hot", n=4000).first()
    sums = np.array([rng.choice(values, 40, replace=False).mean() for _ in range(20_000)])
    p = (1 + (sums >= values[hot].mean()).sum()) / 20_001
    assert abs(got.p_random_sets - p) < 5 * np.sqrt(p * (1 - p) / 4000)
    assert got.p_rank_sum == pytest.approx(special.mann_whitney(got.U, 40, 200, 0, "greater"))
    again = stats.random_sets(df, "hot", n=4000).first()
    assert again == got
    assert stats.random_sets(df.where("not hot"), "hot", n=10).first().p_random_sets is None
    counts = np.array([stats.allotted([5, 0, 30, 5], 10, d, 1) for d in range(3000)])
    assert (counts.sum(1) == 10).all() and (counts <= [5, 0, 30, 5]).all() and counts.mean(0) == pytest.approx([1.25, 0, 7.5, 1.25], abs=0.1)
    assert len(set(stats.drawn(30, 12, 0, 3, 1).tolist())) == 12


# counterfactual permutations


def test_moves_of_chunks_are_one_permutation():
    sizes, seen = [7, 4, 9], np.zeros((20, 20))
    starts = np.cumsum([0, *sizes])
    for deal in range(4000):
        to_from = np.full(20, -1)
        for to in range(3):
            for of in range(3):
                place, source = counterfactual.moved(sizes, to, of, [1, 2, deal])
                assert len(place) == len(source)
                to_from[starts[to] + place] = starts[of] + source
        assert sorted(to_from.tolist()) == list(range(20))
        seen[np.arange(20), to_from] += 1
    chi2 = ((seen - 200) ** 2 / 200).sum()
    assert chi2 < 361 + 6 * np.sqrt(2 * 361)  # every place gets every value alike


@pytest.fixture(scope="module")
def burden(spark):
    rng = np.random.default_rng(9)
    who = [(f"s{i}", "AC" if i < 4 else "TOL", True, i != 2) for i in range(9)]
    rows = [(s, t, float(np.round(rng.exponential(3), 3)), None if t == 5 else float(np.round(rng.normal(), 3)), None if t == 6 else bool(rng.integers(3) == 0), None if t == 7 else int(rng.integers(20)), float(rng.integers(9))) for s, *_ in who for t in range(30)]
    rows += [("zero", t, 0.0, 1.0, True, 3, 1.0) for t in range(3)]
    who.append(("zero", "TOL", True, True))
    cols = ["sample", "id", "tpm", "index", "strict", "length", "expression"]
    return pd.DataFrame(rows, columns=cols), spark.createDataFrame(rows, "sample string, id int, tpm double, index double, strict boolean, length int, expression double"), pd.DataFrame(who, columns=["sample", "grp", "all", "some"]), spark.createDataFrame(who, "sample string, grp string, all boolean, some boolean")


def _differences(frame, who, index, strict):
    """The five endpoints' differences for each set, by plain sums."""
    out = []
    tpm = frame["tpm"].to_numpy()
    for flag in ("all", "some"):
        per = {}
        for s, at in frame.groupby("sample").indices.items():
            w, i, l = tpm[at], index[at], strict[at]
            total = w.sum()
            per[s] = [(w * l).sum() / total if total else np.nan, (w * l).sum(), l[w >= 1].sum(), (w * i * l).sum(), (w * i).sum() / total if total else np.nan]
        mean = {g: np.nanmean([per[r.sample] for r in who.itertuples() if getattr(r, flag) and r.grp == g], axis=0) for g in ("AC", "TOL")}
        out += (mean["TOL"] - mean["AC"]).tolist()
    return out


def test_counterfactual_null_against_a_plain_loop(spark, burden):
    pdf, df, who, groups = burden
    keyed = counterfactual.first_rank_bin(counterfactual.first_rank_bin(df, "length", ["sample", "id"], "lb", 3), "expression", ["sample", "id"], "eb", 2)
    frame = keyed.withColumn("__bin", F.xxhash64("lb", "eb")).toPandas().sort_values(["__bin", "sample", "id"], ignore_index=True)
    r = frame.sort_values(["length", "sample", "id"], na_position="last")["lb"].dropna()
    known = frame["length"].notna().sum()
    want = np.maximum(0, np.ceil(np.arange(known) * 3 / (known - 1)).astype(int) - 1)
    assert r.to_list()[:known] == want.tolist() and (frame.loc[frame["length"].isna(), "lb"] == 0).all()
    got = counterfactual.null_differences(keyed, groups, ["all", "some"], "AC", "TOL", ["lb", "eb"], 20, seed=3).toPandas().set_index("perm").sort_index()
    index, strict = frame["index"].fillna(0).to_numpy(float), frame["strict"].map(lambda x: float(x is True)).to_numpy()
    assert got.loc[-1].to_list() == pytest.approx(_differences(frame, who, index, strict))
    for deal in range(20):
        i, l = index.copy(), strict.copy()
        for key, at in frame.groupby("__bin").indices.items():
            source = counterfactual.moved([len(at)], 0, 0, [3, int(key) & (2**64 - 1), deal])[1]
            i[at], l[at] = index[at][source], strict[at][source]
        assert got.loc[deal].to_list() == pytest.approx(_differences(frame, who, i, l))


def test_counterfactual_chunks_are_not_shuffled_again(spark, burden):
    """Weights and values lie in the written chunks; where each is worked on once, no exchange carries them a second time."""
    _, df, _, groups = burden
    keyed = counterfactual.first_rank_bin(df, "length", ["sample", "id"], "lb", 3)
    plan = counterfactual.null_differences(keyed, groups, ["all", "some"], "AC", "TOL", ["lb"], 20, seed=3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "REPARTITION_BY" not in plan


def test_counterfactual_chunks_have_the_same_null(spark, burden, monkeypatch):
    _, df, _, groups = burden
    whole = {(r.analysis_set, r.metric): r for r in counterfactual.counterfactual_null(df, groups, ["all", "some"], n=3000, bins=2).collect()}
    monkeypatch.setattr(counterfactual, "CHUNK", 16)
    cut = {(r.analysis_set, r.metric): r for r in counterfactual.counterfactual_null(df, groups, ["all", "some"], n=3000, bins=2).collect()}
    assert set(whole) == set(cut) and len(cut) == 10
    for k, a in whole.items():
        b = cut[k]
        assert a.n_permutations == b.n_permutations == 3000 and a.observed_delta == pytest.approx(b.observed_delta)
        assert abs(a.null_mean - b.null_mean) < 6 * a.null_sd / np.sqrt(3000) and b.null_sd == pytest.approx(a.null_sd, rel=0.1)
        assert abs(a.p_greater - b.p_greater) < 0.06 and b.p_two_sided == pytest.approx(min(1, 2 * min(b.p_greater, b.p_less)))


# greedy matching


def _plain_match(rows, order_cols, features, same):
    """(treated, control, distance) by looking at every free control for every treated row."""
    pdf = pd.DataFrame(rows)
    x = pdf[features].to_numpy(float)
    sd = x.std(0)
    x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    free = sorted(np.flatnonzero(~pdf["hot"]).tolist(), key=lambda i: pdf["id"][i])
    out = []
    for k in sorted(np.flatnonzero(pdf["hot"]).tolist(), key=lambda i: (*(-pdf[c][i] for c in order_cols), pdf["id"][i])):
        if not free:
            break
        d = np.sqrt(((x[free] - x[k]) ** 2).sum(1))
        for c in same:
            if pdf[c][k] is not None and any(pdf[c][i] is not None for i in free):
                d = d + np.array([0 if pdf[c][i] == pdf[c][k] else 2 for i in free])
        j = int(d.argmin())
        out.append((pdf["id"][k], pdf["id"][free[j]], float(d[j])))
        free.pop(j)
    return sorted(out)


@pytest.mark.parametrize("same", [[], ["a"], ["a", "b"]])
@pytest.mark.parametrize("grid", [False, True])
def test_matching_equals_the_plain_loop(spark, same, grid):
    rng = np.random.default_rng(len(same) + 10 * grid)
    value = (lambda: float(rng.integers(4))) if grid else (lambda: float(rng.normal()))  # a grid: most distances tie
    rows = [{"p": "s", "id": int(i), "hot": bool(rng.integers(3) == 0), "u": value(), "v": value(), "a": "xyz"[rng.integers(3)] if rng.integers(8) else None, "b": "mn"[rng.integers(2)] if rng.integers(3) else None} for i in rng.permutation(260)]
    df = spark.createDataFrame(rows, "p string, id int, hot boolean, u double, v double, a string, b string")
    got = cohort.match_controls(df, "p", "hot", ["u", "v"], ["u", "v"], "id", same)
    got = sorted((r.treated_id, r.control_id, r.distance) for r in got.collect())
    want = _plain_match(rows, ["u", "v"], ["u", "v"], same)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-12)


@pytest.mark.parametrize("n_same", [0, 1, 2])
@pytest.mark.parametrize("grid", [False, True])
def test_small_parts_are_matched_without_a_search(monkeypatch, n_same, grid):
    """A search in sorted tables for every treated row took most of the time, where a part has few rows."""
    rng = np.random.default_rng(n_same + 10 * grid)
    monkeypatch.setattr(cohort, "CELLS", 700)  # tables of a few rows
    for treated, free in ((90, 150), (60, 40), (0, 5), (5, 0)):
        make = lambda n: (rng.integers(4, size=(n, 2)).astype(float) if grid else rng.normal(size=(n, 2)), rng.integers(-1, 3, (n, n_same)))
        (x, mine), (own, held) = make(treated), make(free)
        held[5:, 1:] = -1  # few have a value: all of them are taken before the end
        want = cohort._by_search(x, own, mine, held)
        with monkeypatch.context() as m:
            m.setattr(cohort, "Free", None)
            got = cohort._from_tables(x, own, mine, held)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist() and len(got[0]) == min(treated, free)


def test_large_parts_are_searched(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [{"p": "s", "id": int(i), "hot": i % 50 == 0, "u": float(rng.normal()), "v": float(rng.normal()), "a": "xyz"[rng.integers(3)]} for i in range(4500)]
    assert sum(not r["hot"] for r in rows) > cohort.NEAR
    got = cohort.match_controls(spark.createDataFrame(rows, "p string, id int, hot boolean, u double, v double, a string"), "p", "hot", ["u"], ["u", "v"], "id", ["a"])
    want = _plain_match(rows, ["u"], ["u", "v"], ["a"])
    assert sorted((r.treated_id, r.control_id) for r in got.collect()) == [r[:2] for r in want]


def test_matching_runs_out_of_controls_and_leaves_odd_rows(spark):
    rows = [("s", 1, True, 1.0), ("s", 2, True, 2.0), ("s", 3, False, 1.0), ("s", 4, False, None), ("t", 5, True, 1.0), ("u", 6, False, 1.0)]
    got = cohort.match_controls(spark.createDataFrame(rows, "p string, id int, hot boolean, u double"), "p", "hot", ["u"], ["u"], "id").collect()
    assert [(r.p, r.treated_id, r.control_id) for r in got] == [("s", 2, 3)]


def test_observed_differences_pair_no_chunks(spark, burden, monkeypatch):
    monkeypatch.setattr(counterfactual, "CHUNK", 16)
    _, df, who, groups = burden
    keyed = counterfactual.first_rank_bin(counterfactual.first_rank_bin(df, "length", ["sample", "id"], "lb", 3), "expression", ["sample", "id"], "eb", 2)
    run = lambda n: counterfactual.null_differences(keyed, groups, ["all", "some"], "AC", "TOL", ["lb", "eb"], n, seed=3)
    alone = run(0)
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()
    assert list(alone.first()) == pytest.approx(list(run(2).where("perm < 0").first()))


def test_dealt_classes_are_one_permutation():
    counts, sizes = np.array([9, 1, 5, 5]), [7, 4, 9]
    for table in (counterfactual.class_table(counts), None):
        seen, together, starts = np.zeros((20, 4)), np.zeros((4, 4)), np.cumsum([0, *sizes])
        for deal in range(4000):
            row = np.concatenate([counterfactual.dealt(counterfactual.class_share(counts, sizes, to, [1, 2, deal]), table, np.random.default_rng([5, deal, to])) for to in range(3)])
            assert np.bincount(row, minlength=4).tolist() == counts.tolist()
            seen[np.arange(20), row] += 1
            together[row[3], row[4]] += 1  # of one chunk
            together[row[2], row[15]] += 1  # of two
        want = 4000 * counts / 20
        chi2 = ((seen - want) ** 2 / want).sum()
        assert chi2 < 57 + 6 * np.sqrt(2 * 57)
        pair = 8000 * (np.outer(counts, counts) - np.diag(counts)) / (20 * 19)
        assert ((together - pair) ** 2 / np.maximum(pair, 1e-9))[pair > 0].sum() < 15 + 6 * np.sqrt(30) and together[1, 1] == 0
    big = np.array([50_000, 3, 20_000, 11_000])
    out = counterfactual.dealt(big, counterfactual.class_table(np.array([500, 3, 200, 110])), np.random.default_rng(1))
    assert np.bincount(out).tolist() == big.tolist()


def test_chunks_of_few_classes_meet_no_other(spark, burden, monkeypatch):
    """A chunk that meets every other of its bin makes the work grow with the square of the bin."""
    _, df, _, groups = burden
    coarse = df.withColumn("index", F.round("index"))
    run = lambda rows: counterfactual.null_differences(rows.withColumn("b", F.lit(1)), groups, ["all", "some"], "AC", "TOL", ["b"], 2000, seed=3)
    whole = run(coarse).where("perm >= 0").toPandas()
    monkeypatch.setattr(counterfactual, "CHUNK", 16)
    cut = run(coarse)
    assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()
    cut = cut.where("perm >= 0").toPandas()
    assert len(cut) == 2000 and cut["perm"].nunique() == 2000
    for c in [c for c in whole.columns if c != "perm"]:
        sd = whole[c].std()
        assert abs(whole[c].mean() - cut[c].mean()) < 6 * sd * np.sqrt(2 / 2000) and cut[c].std() == pytest.approx(sd, rel=0.12)
    monkeypatch.setattr(counterfactual, "CLASSES", 4)
    assert "Join" in run(coarse)._jdf.queryExecution().optimizedPlan().toString()


def test_rank_correlation_reads_its_rows_once_and_joins_few_values_without_a_shuffle(spark, tmp_path):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 3000), "x": rng.integers(0, 11, 3000) / 10, "y": rng.normal(size=3000)})
    pdf["y"] += pdf["x"]
    spark.createDataFrame(pdf).write.parquet(f"file://{tmp_path}/rows")
    rows = spark.read.parquet(f"file://{tmp_path}/rows")
    out = stats.rank_correlation(rows, "x", "y", ["k"])
    assert not set(out.inputFiles()) & set(rows.inputFiles())  # counted once, not for each rank and mean again
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        one = pdf[pdf["k"] == r.k]
        assert r.n == len(one) and r.pearson == pytest.approx(one["x"].corr(one["y"])) and r.spearman == pytest.approx(one["x"].rank().corr(one["y"].rank()))
