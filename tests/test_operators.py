"""Operators on small hand-made inputs with known results."""

import inspect
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from burdock.functions import descriptors, labels, sequence, sixmers, special
from burdock.operators import cohort, enrichment, proteome, scoring, stats
from burdock.plans import registry
from burdock.sources import readers, writers
from burdock.streaming.scoring import event_counts, score_landing
from pyspark.sql import functions as F

GENOME = "ATGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, sequence.clean(lit("mka* zzACDEFG"))) == "MKAACDEFG"
    assert one(spark, sequence.translate_dna(lit("ATGAAATAAGGG"))) == "MK"
    assert one(spark, sequence.translate_dna(lit("AT"))) == "" and one(spark, sequence.translate_dna(lit("ATGNNN"))) == "MX"
    assert one(spark, sequence.reverse_complement(lit("ATGCCN"))) == "NGGCAT"
    assert [one(spark, sequence.cut_stops(lit(s))) for s in ("MAAA.BBB", "MAA.BB.CC", "MPEPTIDE", ".A")] == ["MAAA", None, "MPEPTIDE", None]
    assert one(spark, sequence.sixmer_codes(lit("VQIVYK"))) == [2 * 7776 + 5 * 1296 + 2 * 216 + 2 * 36 + 3 * 6 + 1]
    assert one(spark, sequence.sixmer_codes(lit("VQIVY"))) == [] and one(spark, sequence.windows(lit("ABC"), 2)) == ["AB", "BC"]
    assert [len(x) for x in one(spark, sequence.wrap(lit("A" * 165))).split("\n")] == [80, 80, 5]
    assert one(spark, sequence.normal_allele(lit(" a_x hla_a*02:01:01g"))) == "HLA-A*02:01:01G" and one(spark, sequence.normal_locus(lit("hla_drb1*15"))) == "DRB1"
    assert one(spark, sequence.transcript_id(lit("H1_ENST0000012.3"))) == "ENST0000012" and one(spark, sequence.transcript_id(lit("x"))) is None
    assert one(spark, writers.ten_digits(lit(0.887344))) == "0.887344" and one(spark, writers.ten_digits(lit(2.0))) == "2"


def test_stops_of_every_word(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d.e f.g.h .i"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.load()[0]["stop_cleaning"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.kept) for r in sorted(got, key=lambda r: r.pos)] == [(1, k) for k in ("a", "b", "c", "d", None, None)]


def test_labels(spark):
    assert [one(spark, labels.label(F.lit(p))) for p in (0.50001, 0.5)] == ["AMYLOID", "Non-Amyloid"]
    assert [one(spark, labels.normal(F.lit(x))) for x in (" AMYL", "non_amyloid", "", None, "Odd")] == ["Amyloid", "Non-Amyloid", "NA", "NA", "odd"]
    a, n, na = F.lit("Amyloid"), F.lit("Non-Amyloid"), F.lit("NA")
    assert [one(spark, labels.consensus(*x)) for x in ((a, a), (a, n), (a, na), (na, na), (a, a, a), (a, a, na), (n, a, na))] == ["Amyloid", "Discordant", "Partial", "NA", "Amyloid", "Partial", "Discordant"]
    df = spark.createDataFrame([("Discordant",), ("Non-Amyloid",), (None,)], "l string")
    assert df.agg(labels.first_of(F.col("l")).alias("x")).first().x == "Discordant"


def test_descriptors(spark):
    s = "MKVLAAGIVYW"
    light = spark.range(1).select(*(e.alias(k) for k, e in descriptors.light(F.lit(s)).items())).first()
    from burdock.schema import HYDROPATHY

    kd = [HYDROPATHY[c] for c in s]
    assert light.KD_mean == pytest.approx(np.mean(kd)) and light.KD_sd == pytest.approx(np.std(kd)) and light.KD_max == 4.5 and light.charge == 1
    pairs = [s[i : i + 2] for i in range(len(s) - 1)]
    assert one(spark, descriptors.dpc(F.lit(s))) == {p: pytest.approx(pairs.count(p) / len(pairs)) for p in set(pairs)}
    assert one(spark, descriptors.sliding_means(descriptors.scale_values(F.lit(s), HYDROPATHY))) == pytest.approx([np.mean(kd[i : i + 7]) for i in range(5)])
    triads = one(spark, descriptors.triads(F.lit("AGVAGV")))
    assert triads == {"111": 1.0}
    d = spark.range(1).select(*(e.alias(k) for k, e in descriptors.ctdd(F.lit("RKAAC")).items())).first().asDict()
    assert (d["charge_1_0"], d["charge_1_100"], d["charge_2_50"], d["charge_3_0"]) == (20.0, 40.0, 60.0, 0.0)


def test_scoring_and_forest(spark):
    table = np.full(6**6, 0.1)
    for code, p in zip(spark.range(1).select(sequence.sixmer_codes(F.lit("VQIVYKACD")).alias("c")).first().c, (0.25, 0.91, 0.10, 0.50), strict=True):
        table[code] = p
    df = spark.createDataFrame([("a", "VQIVYKACD"), ("b", "xxVQIVYKACD***"), ("c", "ACD"), ("d", "***zzz"), ("e", None)], "id string, sequence string")
    got = {r.id: r for r in scoring.predict(spark, df, table).collect()}
    assert got["a"].prob == got["b"].prob == 0.91 and got["a"].label == "AMYLOID"
    assert [got[k].status for k in "cde"] == ["shorter_than_6", "empty_after_cleaning", "empty_after_cleaning"] and got["c"].prob is None
    trees = [{"left": [1, 0, 0], "right": [2, 0, 0], "feature": [0, 0, 0], "split": [0.5, 0, 0], "counts": [[0, 0], [9, 1], [2, 8]]}]
    assert scoring.forest_probability(trees, np.array([[0], [1]])).tolist() == [0.1, 0.8]
    feats = scoring.multigrams()
    assert len(feats) == 798
    on = scoring.feature_matrix(feats, np.array([[2, 5, 2, 2, 3, 1]]))[0]
    assert on[feats.index(((2,), ()))] and on[feats.index(((2, 2), (1,)))] and not on[feats.index(((0,), ()))]


@pytest.fixture
def prepared(tmp_path):
    gtf = 'chrF\tx\t{}\t1\t39\t.\t+\t.\tgene_id "GENE_FIXTURE"; transcript_id "TX000001"; gene_name "old"; gene_name "fx";\n'
    (tmp_path / "a.gtf").write_text("#c\n" + "".join(gtf.format(f) for f in ("transcript", "exon", "CDS")))
    (tmp_path / "v.vcf").write_text("##m\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nchrF\t4\t.\tG\tA\t.\tLOW\t.\tGT\t0/1\nchrF\t10\t.\tG\tGT,GC\t.\tPASS\t.\tGT\t0/1\n")
    (tmp_path / "g.fa").write_text(f">chrF d\n{GENOME[:20]}\n\n{GENOME[20:]}\n>empty\n")
    (tmp_path / "ab.tsv").write_text("target_id\tlength\teff_length\test_counts\ttpm\nTX000001|g|x|x|x|name\t30\t20\t100\t10.0\nTX2\t3\t3\t3\tbad\n")
    return tmp_path


def test_prepared_fixture(spark, prepared):
    p = str(prepared)
    features = readers.gtf(spark, f"{p}/a.gtf")
    assert features.select(readers.attribute("gene_name").alias("g")).distinct().collect()[0].g == "fx"
    tx = proteome.transcripts(features)
    ab = readers.abundance(spark, f"{p}/ab.tsv")
    assert [(r.transcript_id, r.gene_name) for r in ab.collect()] == [("TX000001", "name")]
    assert [r.id for r in proteome.expressed_ids(tx, ab).collect()] == ["TX000001"]
    fa = readers.fasta(spark, f"{p}/g.fa")
    assert [(r.id, r.sequence) for r in fa.orderBy("ord").collect()] == [("chrF", GENOME), ("empty", "")]
    with pytest.raises(ValueError):
        readers.strict(fa)
    genome = fa.select(F.col("id").alias("chrom"), F.col("sequence").alias("seq"))
    got = proteome.frameshift_proteins(readers.vcf(spark, f"{p}/v.vcf"), tx, genome).collect()
    assert [(r.header, r.sequence) for r in got] == [("FRAMESHIFT_GENE_FIXTURE_TX000001 type=INS shift=1bp WT=7 MUT=13 diff=6", "MAIVNGPLKGCPI")]
    cds = spark.createDataFrame([("TX000001", "chrF", "+", 1, 39, GENOME)], "transcript_id string, chrom string, strand string, start int, end int, seq string")
    snps = spark.createDataFrame([("chrF", 4, "A", "0|1")], "chrom string, pos int, alt string, gt string")
    assert [proteome.haplotype_proteins(snps, cds, h).first().sequence for h in (1, 2)] == ["MAIVMGR", "MTIVMGR"]
    out = f"{p}/out"
    writers.fasta(fa.where("id = 'chrF'"), out)
    assert readers.fasta(spark, out).first().sequence == GENOME


def test_hla_readers_and_consensus(spark, tmp_path):
    text = spark.createDataFrame([('{"A":["A*02:01","HLA-A*24:02"],"B":["B*07:02"]}',)], "value string")
    assert [(r.locus, r.allele, r["rank"]) for r in readers.hla_json(text, "s", "j").orderBy("allele").collect()] == [("A", "HLA-A*02:01", 1), ("A", "HLA-A*24:02", 2), ("B", "HLA-B*07:02", 1)]
    wide = spark.createDataFrame([("A*01:01", "A*02:01", "B*07:02", "C*04:01"), ("x",) * 4], "A1 string, A2 string, B1 string, C1 string")
    assert readers.hla_wide(wide, "s", "w").count() == 4
    deep = spark.createDataFrame([('{"A":{"calls":[{"allele":"A*02:01","score":1},"HLA-A*24:02"],"B*08:01":null},"B":"B*07:02","n":3,"C":["x \\"q\\" C*04:01",["C*04:01"]]}',)], "value string")
    assert [(r.locus, r.allele, r["rank"]) for r in readers.hla_json(deep, "s", "j").orderBy("allele").collect()] == [("A", "HLA-A*02:01", 1), ("A", "HLA-A*24:02", 2), ("B", "HLA-B*07:02", 2), ("B", "HLA-B*08:01", 1), ("C", "HLA-C*04:01", 1)]
    log = spark.createDataFrame([("found HLA-DRB1*15:01 and DQB1*06:02",), ("none",)], "value string")
    assert sorted(r.allele for r in readers.hla_log(log, "s", "l").collect()) == ["HLA-DQB1*06:02", "HLA-DRB1*15:01"]
    calls = [("s", c, "A", "A*02:01", 1, "f") for c in ("x", "y")] + [("s", "x", "A", "A*24:02", 2, "f")] + [("s", c, "B", f"B*0{i}:01", 1, "f") for i, c in enumerate("xyz")]
    got = proteome.hla_consensus(spark.createDataFrame(calls, "sample string, caller string, locus string, allele string, rank int, source_file string")).orderBy("locus", "allele").collect()
    assert [r.consensus_status for r in got] == ["CONSENSUS", "LOW_SUPPORT", "CONFLICT", "CONFLICT"] and got[0].support_callers == "x,y"


def test_hla_queries_read_every_row(spark, tmp_path):
    lines = [(k, 9, "RAN"[k % 3], 1 + k % 2, k, "F") for k in range(1, 31)]  # no order key is a multiple of 50
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string, l_linenumber int, l_partkey long, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries = registry.load()[0]
    ranks = {(r.caller, r.locus, r.allele) for r in queries["hla_ranks"](spark, str(tmp_path)).collect()}
    assert ranks == {(c, "BC"[n - 1], f"HLA-{'BC'[n - 1]}*0{k % 5}:01") for k, _, c, n, _, _ in lines}
    top = queries["hla_consensus"](spark, str(tmp_path)).collect()
    assert sorted(r.locus for r in top) == ["B", "B", "C", "C"] and {(r.caller_count, r.support_count, r.consensus_status) for r in top} == {(3, 3, "CONSENSUS")}


def test_distributions_against_direct_sums():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12) and special.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-13)
    for n, m in ((2, 3), (4, 5), (1, 6)):
        us = [sum(r for r in c) - n * (n + 1) // 2 for c in itertools.combinations(range(1, n + m + 1), n)]
        assert special.rank_sum_counts(n, m).tolist() == [us.count(u) for u in range(n * m + 1)]
    assert special.mann_whitney(6, 2, 3, 0.0) == pytest.approx(0.2) and special.binomial_tail(2, 3) == pytest.approx(0.5, abs=1e-12)
    low, high = special.clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(1 - 0.025**0.1, abs=1e-9)


def test_permutation_and_ols(spark):
    rows = [("m", "AC" if i < 4 else "TOL", float(v)) for i, v in enumerate((1, 2, 4, 7, 3, 8, 9))]
    got = stats.exact_permutation(spark, spark.createDataFrame(rows, "metric string, grp string, value double"), "AC", "TOL", ["metric"]).first()
    values, obs = [r[2] for r in rows], np.mean([3, 8, 9]) - 3.5
    all_d = [np.mean(c) - (sum(values) - sum(c)) / 4 for c in itertools.combinations(values, 3)]
    assert got.n_permutations == 35 and got.p_greater == pytest.approx((sum(d >= obs - 1e-15 for d in all_d) + 1) / 36)
    x = np.arange(20.0)
    df = spark.createDataFrame([(float(v), float(3 + 2 * v + (-1) ** v)) for v in x], "x double, y double")
    coef = {r.term: r.coef for r in stats.ols(spark, df, "y", ["x"]).collect()}
    want = np.polyfit(x, 3 + 2 * x + (-1) ** x, 1)
    assert coef["x"] == pytest.approx(want[0]) and coef["intercept"] == pytest.approx(want[1])


def test_subsets_are_counted_by_halves(spark):
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (7, 3), (10, 5), (11, 2), (12, 11)):
        v = np.round(rng.normal(size=n), 1)
        sums = np.array([sum(c) for c in itertools.combinations(v, k)])
        for bound in (-9, -0.55, 0.05, 1.15, 99):
            assert stats.subsets_at_least(v, k, bound) == (sums >= bound).sum()
    rows = [("m", "TOL" if i % 3 else "AC", float(v)) for i, v in enumerate(rng.normal(size=30))]
    df = spark.createDataFrame(rows, "metric string, grp string, value double")
    got = stats.exact_permutation(spark, df, "AC", "TOL", ["metric"]).first()
    deals = stats.exact_permutation(spark, df, "AC", "TOL", ["metric"], most=0).first()
    assert got.exact and got.n_permutations == math.comb(30, 10) and not deals.exact and deals.n_permutations == 10_000
    assert got.p_greater == pytest.approx(deals.p_greater, abs=0.02) and got.p_two_sided == pytest.approx(deals.p_two_sided, abs=0.02)


def test_bootstrapped_effects_and_random_sets(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(1, 9)), np.round(rng.normal(size=(1, 14)) + 1, 1)
    sd = math.sqrt((8 * x.var(ddof=1) + 13 * y.var(ddof=1)) / 21)
    assert stats.hedges(x, y)[0] == pytest.approx((y.mean() - x.mean()) / sd * (1 - 3 / 83))
    assert stats._ranks(np.array([[3.0, 1, 3, 2, 3], [1, 1, 1, 1, 1]])).tolist() == [[4, 1, 4, 2, 4], [3] * 5]
    rows = [("m", "AC", float(a), float(b)) for a, b in zip(x[0], rng.normal(size=9), strict=True)] + [("m", "TOL", float(a), float(a + b)) for a, b in zip(y[0], rng.normal(size=14), strict=True)] + [("few", "AC", 1.0, 1.0), ("few", "TOL", 2.0, None)]
    df = spark.createDataFrame(rows, "metric string, grp string, u double, v double")
    got = {r.effect: r for r in stats.bootstrap_effects(df, "AC", "TOL", ["metric"], y="u", n=1500).collect()}
    assert set(got) == {"hedges_g", "mean_b"} and got["hedges_g"].observed == pytest.approx(stats.hedges(x, y)[0])
    assert got["mean_b"].low < y.mean() < got["mean_b"].high and got["hedges_g"].low < got["hedges_g"].observed < got["hedges_g"].high
    got = {r.effect: r for r in stats.bootstrap_effects(df, "AC", "TOL", ["metric"], "u", "v", n=1500).collect()}
    by = {g: np.array([r[2:] for r in rows if r[0] == "m" and r[1] == g]) for g in ("AC", "TOL")}
    slope = {g: np.polyfit(*a.T, 1)[0] for g, a in by.items()}
    assert got["interaction"].observed == pytest.approx(slope["TOL"] - slope["AC"])
    assert got["pearson_diff"].observed == pytest.approx(np.corrcoef(by["TOL"].T)[0, 1] - np.corrcoef(by["AC"].T)[0, 1])
    genes = [(1, float(v), i < 4) for i, v in enumerate([5, 6, 7, 8, 1, 2, 3, 4, 9, 0])]
    one = stats.random_sets(spark.createDataFrame(genes, "k int, value double, hot boolean"), "hot").first()
    means = [np.mean(c) for c in itertools.combinations([g[1] for g in genes], 4)]
    assert one.U == 20 and one.auc == 20 / 24 and one.mean_difference == pytest.approx(6.5 - 19 / 6)
    assert one.p_random_sets == pytest.approx(np.mean(np.array(means) >= 6.5), abs=0.02)
    us = [sum(a > b for a in c for b in set(range(10)) - set(c)) for c in itertools.combinations(range(10), 4)]
    assert one.p_rank_sum == pytest.approx(np.mean(np.array(us) >= 20))


def test_p_values_of_correlations_and_tables(spark):
    df = spark.createDataFrame([("k", float(x), float(y)) for x, y in zip(range(6), (1, 3, 2, 5, 4, 6), strict=True)], "k string, x double, y double")
    r = stats.with_correlation_p(stats.rank_correlation(df, "x", "y", ["k"])).first()
    t = r.pearson * math.sqrt(4 / (1 - r.pearson**2))
    assert r.pearson_p == pytest.approx(special.t_two_sided(t, 4)) and r.pearson_p == r.spearman_p
    c = stats.with_normal_interval(spark.createDataFrame([(2.0, 1.0)], "contrast double, se_hc3 double")).first()
    assert c.p == pytest.approx(0.04550026389635842) and (c.low, c.high) == pytest.approx((2 - 1.959964, 2 + 1.959964), abs=1e-6)
    rows = [(f"g{g}", f"s{s}", "AC" if s < 3 else "TOL", float(20 + g * s + (s * 7) % 3)) for g in range(4) for s in range(6)] + [("low", f"s{s}", "AC" if s < 3 else "TOL", 1.0) for s in range(6)]
    out = {r.gene: r for r in stats.de_table(spark.createDataFrame(rows, "gene string, sample string, grp string, counts double"), "AC", "TOL", "gene").collect()}
    assert set(out) == {"g0", "g1", "g2", "g3"} and all(r.p <= r.fdr <= 1 for r in out.values()) and out["g3"].log2fc > 0 > out["g0"].log2fc
    assert special.binomial_tail(2500, 5000) == pytest.approx(0.5056, abs=1e-3)


def test_sequential_numbers_and_dense_matrix(spark):
    rows = spark.createDataFrame([(str(i % 3), i) for i in range(200)], "k string, v int").repartition(7)
    got = sorted((r.place, r.k, r.v) for r in cohort.numbered(rows, [cohort.by_list("k", ["2", "0"]), F.desc("v")], "place").collect())
    want = sorted(range(200), key=lambda i: ({2: 1, 0: 2, 1: 3}[i % 3], -i))
    assert [(p, v) for p, _, v in got] == list(enumerate(want, 1))
    cells = spark.createDataFrame([("a", "x", 1.0, 0), ("a", "x", 2.0, 1), ("b", "y", 3.0, 0), ("b", "z", 9.0, 0)], "sample string, id string, value double, ord int")
    assert sorted(map(tuple, cohort.dense(cells, ["b", "a"]).collect())) == [("x", None, 2.0), ("y", 3.0, None), ("z", 9.0, None)]
    assert cohort.matrix_slice(cells, ["a"], ["x"]).count() == 2


def test_flags_clips_and_fallbacks(spark):
    from burdock.functions import labels

    df = spark.createDataFrame([("Plasma Membrane", None, 1.0, "Amyloid", None, "Amyloid", "protein_coding"), (None, None, None, None, "NA", None, "lncRNA"), ("x", "Nuclear speckle", 9.0, None, "Amyloid", "Non-Amyloid", "protein_coding")], "a string, b string, v double, new string, old string, other string, bio string")
    flags = labels.keyword_flags(["a", "b"], {"membrane": ("plasma membrane", "cell junction"), "nucleus": ("nuclear",)})
    got = df.select(*(e.alias(k) for k, e in flags.items()), labels.clip(F.col("v"), 2.0, 5.0).alias("c"), labels.with_fallback(F.col("new"), F.col("old"), F.col("other")).alias("f"), labels.coding_only(F.col("new"), F.col("bio"), "unannotated").alias("m")).collect()
    assert [tuple(r) for r in got] == [(True, False, 2.0, "Amyloid", "Amyloid"), (False, False, None, "Partial", None), (False, True, 5.0, "Discordant", "unannotated")]
    odd = spark.createDataFrame([("ACDX",), ("A" * 40 + "X",), ("",), (None,)], "s string")
    assert [r[0] for r in odd.select(sequence.exploded(F.col("s"))).collect()] == [True, False, False, False]


def test_light_profile_equals_the_expressions(spark):
    from burdock.functions import descriptors, profiles

    texts = ["ACDEFGHIKLMNPQRSTVWY", "mkv*x", "", None, "ß", "WWWW"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string")
    want = df.select("id", sequence.clean(F.coalesce("s", F.lit(""))).alias("s")).select("id", *(e.alias(k) for k, e in descriptors.light(F.col("s")).items())).orderBy("id").collect()
    got = profiles.light_features(df, "s").drop("s").orderBy("id").collect()
    assert [r.asDict().keys() for r in got] == [r.asDict().keys() for r in want]
    for a, b in zip(got, want, strict=True):
        assert [x if x is None else pytest.approx(x, abs=1e-9) for x in b][1:] == list(a)[1:]


def test_variant_filters(spark):
    from burdock.operators import variants

    rows = [(0, "c", 100, "FS=31.5;QD=9"), (1, "c", 110, "FS=1;QD=1.5"), (2, "c", 134, "DP=3"), (3, "c", 200, "QD=x"), (4, "d", 100, None), (5, "d", 135, "FS=30.0;QD=2.0")]
    got = {r.id: r["filter"] for r in variants.hard_filters(spark.createDataFrame(rows, "id int, chrom string, pos int, info string")).collect()}
    assert got == {0: "SnpCluster;FS", 1: "SnpCluster;QD", 2: "SnpCluster", 3: "PASS", 4: "PASS", 5: "PASS"}


def test_permutation_of_large_keys_uses_all_samples(spark):
    rng = np.random.default_rng(3)
    rows = [(m, "TOL" if i < 5 else "AC", float(v)) for m, shift in (("even", 0), ("up", 1.5)) for i, v in enumerate(rng.normal(size=12) + shift * (np.arange(12) < 5))]
    df = spark.createDataFrame([*rows, ("one", "AC", 1.0), *(("lone", "AC", float(i)) for i in range(30))], "metric string, grp string, value double").repartition(4)
    want = {r.metric: r for r in stats.exact_permutation(spark, df, "AC", "TOL", ["metric"]).collect()}
    runs = [{r.metric: r for r in stats.exact_permutation(spark, df, "AC", "TOL", ["metric"], most=11, n=10_250).collect()} for _ in range(2)]
    assert set(want) == set(runs[0]) == {"even", "up"} and runs[0] == runs[1] and {r.exact for r in want.values()} == {True}
    for m, r in runs[0].items():
        v = [x[2] for x in rows if x[0] == m]
        obs, all_d = np.mean(v[:5]) - np.mean(v[5:]), np.array([np.mean(c) - (sum(v) - sum(c)) / 7 for c in itertools.combinations(v, 5)])
        assert not r.exact and r.n_permutations == 10_250 and r.delta == pytest.approx(obs)
        assert r.p_greater == pytest.approx((all_d >= obs - 1e-12).mean(), abs=0.02) and r.p_two_sided == pytest.approx((np.abs(all_d) >= abs(obs) - 1e-12).mean(), abs=0.02)


def test_resampling_queries_run_the_reference_counts(spark, sf, monkeypatch):
    calls = []
    for mod, name in ((stats, "permute_within"), (stats, "resample"), (enrichment, "enrichment_test")):
        monkeypatch.setattr(mod, name, lambda *a, _f=getattr(mod, name), _n=name, **k: (calls.append((_n, inspect.signature(_f).bind(*a, **k))), calls[-1][1].apply_defaults(), a[0] if _n == "resample" else a[1])[-1])
    queries = registry.load()[0]
    for q in ("within_bin_permutation", "bootstrap_ci", "enrichment_test"):
        queries[q](spark, sf)
    assert [(k, c.arguments["n"]) for k, c in calls] == [("permute_within", 10_000), ("resample", 10_000), ("enrichment_test", 10_000)]


def test_blocks_of_resamples(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=30), rng.normal(size=20) + 0.5
    df = spark.createDataFrame([("m", "AC", float(v)) for v in x] + [("m", "TOL", float(v)) for v in y] + [("lone", "AC", 1.0)], "metric string, grp string, value double")
    got = {r.metric: r for r in stats.resample(df, "AC", "TOL", ["metric"], n=4_100).collect()}
    se = math.sqrt(x.var() / 30 + y.var() / 20)
    assert got["lone"].delta is None and got["lone"].p_permutation is None and got["m"].delta == pytest.approx(y.mean() - x.mean())
    assert got["m"].low == pytest.approx(got["m"].delta - 1.96 * se, abs=0.1 * se + 0.02) and got["m"].high == pytest.approx(got["m"].delta + 1.96 * se, abs=0.1 * se + 0.02)

    rows = [(s, b, w, h) for b, items in (("p", [("s", 1.0, True), ("s", 2.0, False), ("t", 4.0, False)]), ("q", [("s", 8.0, True), ("t", 16.0, False)])) for s, w, h in items]
    null = stats.permute_within(spark, spark.createDataFrame(rows, "sample string, bin string, w double, hot boolean"), ["bin"], "hot", "w", "sample", 4_100)
    got = {r["sample"]: r for r in null.collect()}
    sums = [(a + c) for a in (1, 2, 0) for c in (8, 0)]  # of s, over the places of both labels
    assert got["s"].observed == 9 and got["s"].null_mean == pytest.approx(np.mean(sums), abs=0.2) and got["s"].null_sd == pytest.approx(np.std(sums), abs=0.1)
    assert got["s"].p_greater == pytest.approx(2 / 6, abs=0.04) and got["t"].observed == 0 and got["t"].p_greater == 1

    # more samples x permutations than the former ceiling
    genes = spark.range(4).select(F.format_string("g%d", "id").alias("gene"))
    n = 2_100
    names = spark.range(n).select(F.format_string("s%04d", "id").alias("sample"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("grp"))
    vals = genes.crossJoin(names).select("gene", "sample", (F.xxhash64("gene", "sample") % 1000 / 1000 + F.when((F.col("gene") == "g1") & (F.col("grp") == "b"), 5.0).otherwise(0.0)).alias("value"))
    out = enrichment.enrichment_test(spark, vals, names, spark.createDataFrame([("set", "g1")], "signature string, gene string"), "a", "b", 9_999).first()
    assert out.n_null == 9_999 and out.es == 1.0


def test_labels_within_bins_are_drawn_for_many_rows_by_one_number(monkeypatch):
    """The null of all ways to label a bin, and far fewer random numbers than rows times draws."""
    import itertools

    w = np.array([1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0])
    for size, hot in ((20, 6), (60, 30), (9, 4), (7, 3), (1_000, 100)):
        want: dict[float, float] = {}
        for pick in itertools.product((0, 1), repeat=7):
            k = sum(pick)
            want[float(w @ pick)] = math.comb(size - 7, hot - k) / math.comb(size, hot) if hot >= k and size - 7 >= hot - k else 0.0
        got = stats.draws_within(w, size, hot, 60_000, (5, size))
        for v, p in want.items():
            assert abs((got == v).mean() - p) < 5 * math.sqrt(p * (1 - p) / 60_000) + 1e-12
        a, b = (stats.draws_within(np.ones(25), 400, 80, 60_000, (key,)) for key in (1, 2))
        assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and a.var() == pytest.approx(25 * 0.2 * 0.8 * 375 / 399, rel=0.03)
    assert stats.draws_within(w, 50, 0, 3, (1,)).tolist() == [0] * 3 and stats.draws_within(w, 50, 50, 3, (1,)).tolist() == [127] * 3
    made, plain = [], np.random.default_rng
    monkeypatch.setattr(stats.np.random, "default_rng", lambda key: made.append(key) or plain(key))
    stats.draws_within(np.ones(1000), 100_000, 20_000, 4000, (77,))
    assert len(made) == 1000 / stats.TOGETHER + 1


def test_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    pts = [(int(k), int(x)) for k, x in zip(rng.integers(0, 3, 200), rng.integers(0, 500, 200), strict=True)]
    spans = [(int(k), i, int(a), int(a + w)) for i, (k, a, w) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 500, 40), rng.integers(0, 90, 40), strict=True))]
    got = proteome.range_join(spark.createDataFrame(pts, "k int, x int"), spark.createDataFrame(spans, "k int, i int, a int, b int"), "k", "x", "a", "b", 32).count()
    assert got == sum(k == j and a <= x <= b for k, x in pts for j, _, a, b in spans)


def test_matching_uses_each_control_once(spark):
    rows = [("s", i % 3 == 0, float(i % 7), float(i), i) for i in range(30)]
    got = cohort.match_controls(spark.createDataFrame(rows, "sample string, hot boolean, a double, b double, id int"), "sample", "hot", ["a"], ["a", "b"], "id").collect()
    assert len(got) == 10 and len({r.control_id for r in got}) == 10


def test_matching_adds_two_for_each_mismatch(spark):
    rows = [("s", True, 1.0, 1, "x", "in"), ("s", False, 1.0, 2, "y", None), ("s", False, 2.0, 3, "x", None), ("t", True, 1.0, 4, None, "in"), ("t", False, 1.0, 5, "y", None)]
    df = spark.createDataFrame(rows, "sample string, hot boolean, a double, id int, biotype string, place string")
    run = lambda same: {r.treated_id: (r.control_id, r.distance) for r in cohort.match_controls(df, "sample", "hot", ["a"], ["a"], "id", same).collect()}
    z = 1 / np.std([1.0, 1.0, 2.0])
    assert run([]) == {1: (2, 0.0), 4: (5, 0.0)}
    assert run(["biotype"]) == {1: (2, 2.0), 4: (5, 0.0)}  # z is 2.12: the other control is still farther
    assert run(["place"]) == {1: (2, 0.0), 4: (5, 0.0)} and run(["biotype", "biotype"])[1] == (3, pytest.approx(z))


def test_streaming_scores_new_files_once(spark, tmp_path):
    table, land = scoring.surrogate_table(), str(tmp_path / "in")
    schema = "id string, sequence string"
    for k in range(2):
        spark.createDataFrame([(f"r{k}", "VQIVYKACD")], schema).write.mode("append").parquet(land)
        score_landing(spark, land, schema, str(tmp_path / "out"), str(tmp_path / "ck"), table).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in out.collect()) == ["r0", "r1"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert event_counts(events).agg(F.sum("n")).first()[0] == 1000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200 and set(e.oracle_sql()) <= set(e.queries()) and math.isfinite(len(e.queries()))


def test_profiles(spark):
    from burdock.functions import profiles

    seq = "FLPVLAGLTPSIVPKLVCLLTKKC"
    counts = profiles.Residues([seq]).tally(profiles.Residues([seq]).code, 20)
    assert profiles.net_charge(counts, 7.0, profiles.PK_EMBOSS)[0] == pytest.approx(2.914112, abs=1e-6)
    assert profiles.net_charge(counts, profiles.isoelectric_point(counts), profiles.PK_EMBOSS)[0] == pytest.approx(0, abs=1e-9)
    assert [b - a for a, b in profiles.spans().values()] == [20, 400, 40, 39, 195, 39, 5, 343, 343, 400, 25]
    texts = ["MKVLAAGIVYWRKDECHNQPSTFMKV", "", None, "zz-1", "A", "RKAAC"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, AAC string").repartition(2)
    got = {r.id: r for r in profiles.blocks(rows.select("id", "t"), "t", ["DPC", "CTDD", "CTDT", "KSCTriad", "DDE"]).collect()}
    for native, block in ((descriptors.ctdt, "CTDT"), (descriptors.ctdd, "CTDD")):
        want = {r.id: r for r in rows.where("id in (0, 5)").select("id", *(e.alias(k) for k, e in native(F.col("t")).items())).collect()}
        for i in want:
            assert list(got[i][block]) == pytest.approx(list(want[i])[1:])
    triads = one(spark, descriptors.triads(F.lit(texts[0])))
    assert {k: v for k, v in zip(profiles.BLOCKS["CTriad"][1], got[0].KSCTriad, strict=True) if v} == pytest.approx(triads)
    assert got[0].DDE[profiles._TWO.index("KV")] == pytest.approx(one(spark, descriptors.dde(F.lit(texts[0]), "KV")))
    assert all(x == 0 for i in (1, 2, 3, 4) for x in got[i].DPC) and all(x is None for x in got[4].CTDT)
    whole = {r.id: r.features for r in profiles.assemble(rows, "t").collect()}
    assert all(len(v) == 1849 for v in whole.values()) and all(x is None for x in whole[5][1824:]) and whole[4][1824] is None
    full = {r.id: r for r in profiles.full_features(rows, "t").collect()}
    assert full[1].pI is None and full[4].protein_length == 1 and full[4].KD_mean is None and full[0].KD_sd > 0 and full[0].aromaticity > 0
    assert profiles.blocks(rows.where("false"), "t", ["PAAC"]).count() == 0


def test_pseudo_composition_against_loops():
    from burdock.functions import profiles
    from burdock.schema import PSEUDO_ORDER

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n)) for n in (11, 30, 77)]
    v = {k: dict(zip("ACDEFGHIKLMNPQRSTVWY", profiles._standard(k), strict=True)) for k in profiles.PSEUDO}
    for t, row, amph in zip(texts, profiles.matrix(texts, "PAAC"), profiles.matrix(texts, "APAAC"), strict=True):
        theta = [sum(sum((m[a] - m[b]) ** 2 for m in v.values()) / 3 for a, b in zip(t, t[n:])) / (len(t) - n) for n in range(1, 6)]
        assert list(row) == pytest.approx([t.count(c) / (1 + 0.05 * sum(theta)) for c in PSEUDO_ORDER] + [0.05 * x / (1 + 0.05 * sum(theta)) for x in theta])
        pairs = [sum(v[k][a] * v[k][b] for a, b in zip(t, t[n:])) / (len(t) - n) for n in range(1, 11) for k in ("Hydrophobicity", "Hydrophilicity")]
        assert list(amph)[20:] == pytest.approx([0.05 * x / (1 + 0.05 * sum(pairs)) for x in pairs])


def _running(w, hit):
    """Plain running sum of an ordered list."""
    share = w * hit / (w * hit).sum() if (w * hit).sum() else hit / hit.sum()
    return np.cumsum(share - ~hit / (~hit).sum())


def test_letters_whose_upper_case_is_plain():
    plain = {chr(c): up for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000 and (up := chr(c).upper().encode("ascii", "ignore").decode())}
    assert plain == sixmers.LETTERS and all(len(v) <= len(k.encode()) for k, v in plain.items())
    texts = ["", None, "ßvqivyk", "ab" + "".join(plain) + "VQIVYK", "\u4e2d\u1fb3", *(f"GG{k}{k}GG\U0001f600" for k in plain)]
    clean = ["".join(c for c in (t or "").upper() if c in "ACDEFGHIKLMNPQRSTVWY") for t in texts]
    table = np.random.default_rng(0).random(6**6)
    for arr in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts))):
        lens, best = sixmers.windows(arr, table)
        assert lens.tolist() == list(map(len, clean))
        assert np.array_equal(best, scoring.best_windows(clean, table)[1], equal_nan=True)


def test_smooth_percentiles_against_all_pairs():
    rng = np.random.default_rng(11)
    for x in (rng.normal(size=500), rng.standard_cauchy(300), np.repeat([0.0, 1.0, 5.0], 40), np.array([1.0, 2.0]), np.r_[rng.normal(size=200), 1e6], -rng.exponential(size=90) - 1e4):
        h = x.std(ddof=1) / 4
        want = [math.fsum((1 + math.erf((a - b) / h / math.sqrt(2))) / 2 for b in x) / len(x) for a in x]
        assert np.abs(enrichment.smooth_percentiles(x) - want).max() < 2e-13 * max(1, np.abs(x).max() / x.std())
    x = rng.normal(size=400_000)  # all pairs would be 1.6e11
    assert np.abs(enrichment.smooth_percentiles(x)[np.argsort(x)][199_999] - 0.5) < 0.01


def test_enrichment_against_running_sums(spark):
    rng = np.random.default_rng(5)
    genes, names = [f"g{i:02}" for i in range(40)], [f"s{i}" for i in range(7)]
    x = rng.normal(size=(40, 7)).round(6)
    rows = spark.createDataFrame([(g, s, float(x[i, j])) for i, g in enumerate(genes) for j, s in enumerate(names)], "gene string, sample string, value double").repartition(5)
    sets = {"a": genes[3:11], "b": genes[::5], "top": genes[:1]}
    members = spark.createDataFrame([(k, g) for k, v in sets.items() for g in [*v, "absent"]], "signature string, gene string")
    hits = {k: np.isin(genes, v) for k, v in sets.items()}
    ends = lambda r: (max(r.max(), 0), min(r.min(), 0))
    extreme = lambda r: max(ends(r), key=abs)

    single = {(r.sample, r.signature): r.es for r in enrichment.single_sample(rows, members).collect()}
    varied = {(r.sample, r.signature): r.es for r in enrichment.variation(rows, members).collect()}
    h = x.std(1, ddof=1) / 4
    p = np.array([[np.mean([(1 + math.erf((x[i, j] - v) / h[i] / math.sqrt(2))) / 2 for v in x[i]]) for j in range(7)] for i in range(40)])
    for j, s in enumerate(names):
        order = np.argsort(-x[:, j])
        smooth = np.argsort(-p[:, j].round(12), kind="stable")
        for k, hit in hits.items():
            assert single[s, k] == pytest.approx(_running(np.arange(40, 0, -1.0) ** 0.25, hit[order]).sum())
            assert varied[s, k] == pytest.approx(sum(ends(_running(np.abs(20 - np.arange(40, 0, -1.0)), hit[smooth]))))

    side = np.array([True, True, True, False, False, False, False])
    groups = spark.createDataFrame([(s, "b" if t else "a") for s, t in zip(names, side, strict=True)] + [("other", "c")], "sample string, grp string")
    got = {r.signature: r for r in enrichment.enrichment_test(spark, rows, groups, members, "a", "b", 60, 9).collect()}
    gen = np.random.default_rng(9)
    deals = [side, *(gen.permutation(side) for _ in range(60))]
    for k, hit in hits.items():
        es = []
        for d in deals:
            fc = x[:, d].mean(1) - x[:, ~d].mean(1)
            o = np.argsort(-fc)
            es.append(extreme(_running(np.abs(fc[o]), hit[o])))
        obs, null = es[0], np.array(es[1:])
        assert got[k].es == pytest.approx(obs) and got[k].nes == pytest.approx(obs / abs(null[(null >= 0) == (obs >= 0)].mean()))
        assert got[k].p_greater == pytest.approx(((null >= obs - 1e-12).sum() + 1) / 61, abs=0.02)
    assert enrichment.enrichment_test(spark, rows, groups.where("grp = 'a'"), members, "a", "b", 5).count() == 0
    assert enrichment.single_sample(rows.where("false"), members).count() == 0 and enrichment.variation(rows.where("false"), members).count() == 0


def test_enrichment_edges(spark):
    rows = spark.createDataFrame([("k", f"g{i}", 0.0, i < 2) for i in range(4)] + [("all", "g", 1.0, True)], "k string, gene string, s double, hit boolean")
    got = {r.k: r.es for r in enrichment.enrichment_scores(rows, ["k"], "s", "hit", "gene").collect()}
    assert got == {"k": 1.0, "all": None}


def test_registered_functions(spark):
    from burdock.functions.register import register

    assert "translate_dna" in register(spark)
    df = spark.createDataFrame([("atgAAATAAGGG", "mka* zz", 0.9), ("ATGNNNA", "MA.B", 0.5), ("", "a.b.c", None)], "dna string, s string, p double")
    df.createOrReplaceTempView("registered_input")
    got = spark.sql("SELECT translate_dna(dna) t, reverse_complement(dna) r, clean_seq(s) c, cut_stops(s) k, probability_label(p, 0.5) l, probability_class(p, 0.1, 0.9) q, sixmer_code(sixmer_text(77)) n FROM registered_input")
    assert "BatchEvalPython" not in got._jdf.queryExecution().toString()
    want = df.select(sequence.translate_dna(F.col("dna")).alias("t"), sequence.reverse_complement(F.col("dna")).alias("r"), sequence.clean(F.col("s")).alias("c"), sequence.cut_stops(F.col("s")).alias("k"), labels.label(F.col("p")).alias("l"), labels.by_cuts(F.col("p"), (0.1, 0.9)).alias("q"), F.lit(77).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_passes_leave_a_task_in_slices(spark):
    import pyarrow as pa
    from burdock.functions import profiles

    rows = spark.range(1300).coalesce(1).withColumn("t", F.lit("ACD"))
    sizes = profiles.added(rows, "t", "n int", lambda texts: [pa.array([len(texts)] * len(texts), pa.int32())])
    assert sorted(r["n"] for r in sizes.select("n").distinct().collect()) == [1300 - 2 * profiles.STEP, profiles.STEP]


def test_six_mers_are_counted_in_steps(spark):
    import pyarrow as pa
    from burdock.functions import sixmers

    rng = np.random.default_rng(4)
    texts = [None, "", "ACDEF", *("".join(rng.choice(list("ACDEFGHIKLxz "), n)) for n in rng.integers(0, 400, 3000)), "ß" * 5]
    column = pa.array(texts, pa.string())
    parts = list(sixmers.steps(column))
    assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == len(texts) and max(b - a for a, b in parts) <= sixmers.STEP
    assert list(sixmers.steps(pa.array(["A" * 700_000] * 3))) == [(0, 1), (1, 2), (2, 3)]
    want = {}
    for t in texts:
        c = [x for x in sixmers._LUT[np.frombuffer((t or "").replace("ß", "SS").encode(), np.uint8)] if x < 6]
        for i in range(len(c) - 5):
            code = sum(int(c[i + k]) * 6 ** (5 - k) for k in range(6))
            want[code] = want.get(code, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    assert {r.code: r.n for r in scoring.code_counts(df, "t").collect()} == want


def test_store_by_sample_has_files_for_ranges_not_samples(spark, tmp_path):
    at = tmp_path / "store"
    writers.by_sample(spark.range(3000).select((F.col("id") % 300).alias("sample"), F.col("id").alias("tx"), F.lit(1.0).alias("counts")).repartition(4), str(at))
    assert 0 < len(list(at.rglob("*.parquet"))) <= 8
    back = spark.read.parquet(str(at))
    assert back.count() == 3000 and cohort.matrix_slice(back, [7, 9], [7, 309, 1207], id_col="tx").count() == 3


def test_bins_are_permuted_without_copies_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "_blocks", None)  # rows are not copied for blocks of permutations
    rng = np.random.default_rng(6)
    rows = [(f"s{i % 7}", int(b), float(w), bool(h)) for i, (b, w, h) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(1, 9, 400), rng.random(400) < 0.3, strict=True))]
    got = {r["sample"]: r for r in stats.permute_within(spark, spark.createDataFrame(rows, "sample string, bin int, w double, hot boolean"), ["bin"], "hot", "w", "sample", 20_000).collect()}
    assert len(got) == 7
    for s, r in got.items():
        mean = var = 0.0
        for b in range(3):
            size, hot = sum(x[1] == b for x in rows), sum(x[1] == b and x[3] for x in rows)
            w, p = np.array([x[2] for x in rows if x[0] == s and x[1] == b]), hot / size
            mean += p * w.sum()
            var += p * (1 - p) * ((w**2).sum() - (w.sum() ** 2 - (w**2).sum()) / (size - 1))
        assert r.observed == sum(x[2] for x in rows if x[0] == s and x[3])
        assert r.null_mean == pytest.approx(mean, abs=4 * math.sqrt(var / 20_000)) and r.null_sd == pytest.approx(math.sqrt(var), rel=0.03)


def test_deals_follow_digests():
    import hashlib

    def plain(units, k, deal):
        return set(sorted(range(len(units)), key=lambda i: (hashlib.md5(f"{deal}:{units[i]}".encode()).digest()[:8], i))[:k])

    many = [str(i) for i in range(9000)]
    for units, k in ((many, 4000), (["é" * 3, "", "x" * 40], 2), (["é", "y" * 41, "z"], 1), (["a", "a", "b"], 2)):
        deals = stats.Deals(units, k)
        for deal in (0, 7, 10, 99, 1234, 9999):
            assert set(np.flatnonzero(deals.take(deal)).tolist()) == plain(units, k, deal)
    assert not stats.dealt(["a", "b"], 0, 3).any()
