"""Translation, frameshifts and haplotypes against plain loops; what lies behind the first stop is not translated again."""

import numpy as np
import pyarrow as pa
import pytest
from burdock.functions import codons, sequence
from burdock.operators import proteome, runs
from burdock.schema import CODONS
from pyspark.sql import functions as F

BACK = str.maketrans("ACGTN", "TGCAN")


def _protein(dna):
    return "".join(CODONS.get(dna[i : i + 3], "X") for i in range(0, len(dna) - 2, 3)).split("*")[0]


def _on(strand, dna):
    return dna.translate(BACK)[::-1] if strand == "-" else dna


@pytest.fixture(scope="module")
def genes(spark):
    """Twelve chromosomes with a transcript each, on both strands: exons that overlap, repeat or pass the end, texts without a stop."""
    rng = np.random.default_rng(4)
    letters = lambda k, n: "".join(rng.choice(list("ACG" if k % 4 == 0 else "ACGTN"), n))
    genome = {f"c{k}": letters(k, 160) for k in range(12)}
    exons = [(1, 40), (61, 100), (90, 130), (150, 170)]
    tx = [(f"T{k}.1", f"c{k}", "+-"[k % 2], f"G{k % 3}", exons) for k in range(12)]
    df = spark.createDataFrame(tx, "transcript_id string, chrom string, strand string, gene_id string, exons array<struct<start:int,end:int>>")
    return genome, tx, df, spark.createDataFrame(list(genome.items()), "chrom string, seq string")


def test_translation_of_a_column():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGTTTNé€\U0001f600"), rng.integers(0, 60))) for _ in range(2500)] + [None, "", "AT"] + ["".join(rng.choice(list("ACGT"), rng.integers(0, 60))) for _ in range(1500)]
    want = [_protein(t or "") for t in texts]
    assert codons.proteins(pa.array(texts)).to_pylist() == want
    assert codons.proteins(pa.array(texts).slice(7, 90)).to_pylist() == want[7:97] and codons.proteins(pa.array([], pa.string())).to_pylist() == []


def test_frameshifts_against_a_plain_loop(spark, genes):
    genome, tx, df, chroms = genes
    rng = np.random.default_rng(5)
    found = [(f"c{k}", int(p), r, a, int(100 * k + p)) for k in range(12) for p in rng.choice(np.arange(1, 161), 40, replace=False) for r, a in (("A", "AG"), ("ACG", "A"))]
    got = proteome.frameshift_proteins(spark.createDataFrame(found, "chrom string, pos int, ref string, alt string, ord long"), df, chroms, 2)
    best = {}
    for name, chrom, strand, gene, exons in tx:
        parts = [(a, b, genome[chrom][a - 1 : b]) for a, b in exons]
        plain = _protein(_on(strand, "".join(s for *_, s in parts)))
        for c, pos, ref, alt, at in found:
            if c == chrom and any(a <= pos <= b for a, b in exons):
                changed = "".join(s[: pos - a] + alt + s[pos - a + len(ref) :] if a <= pos <= b else s for a, b, s in parts)
                mut = _protein(_on(strand, changed))
                if len(mut) >= 2:
                    shift = len(alt) - len(ref)
                    header = f"FRAMESHIFT_{gene}_{name} type={'DEL' if shift < 0 else 'INS'} shift={shift}bp WT={len(plain)} MUT={len(mut)} diff={len(mut) - len(plain)}"
                    best.setdefault((gene, mut), []).append((at, name, header))
    first = {k: min(v)[:2] for k, v in best.items()}
    rows = {(r.gene_id, r.sequence): r for r in got.collect()}
    assert set(rows) == set(best) and len(best) > 100
    assert all(r.ord == first[k][0] and (r.ord, next(t for t in (x[1] for x in best[k]) if f"_{t} " in r.header), r.header) in best[k] for k, r in rows.items())


def test_haplotypes_against_a_plain_loop(spark, genes):
    genome, tx, _, _ = genes
    rng = np.random.default_rng(6)
    stretches = [(name, chrom, strand, a, b, genome[chrom][a - 1 : b]) for name, chrom, strand, _, exons in tx for a, b in exons[:2] + exons[3:]]
    calls = [(f"s{rng.integers(3)}", f"c{rng.integers(12)}", int(rng.integers(1, 161)), "ACGT"[rng.integers(4)], ["0|1", "1|0", "1|1"][rng.integers(3)]) for _ in range(150)]
    wanted = [(f"s{s}", f"T{k}.1") for s in range(4) for k in range(12) if (s + k) % 5]
    cds = spark.createDataFrame(stretches, "transcript_id string, chrom string, strand string, start int, end int, seq string")
    got = runs.haplotypes(spark.createDataFrame(calls, "sample string, chrom string, pos int, alt string, gt string"), cds, spark.createDataFrame(wanted, "sample string, transcript_id string"))
    want = {}
    for s, t in wanted:
        for h in (1, 2):
            dna = ""
            for name, chrom, strand, a, b, seq in stretches:
                if name == t:
                    own = dict(sorted((p, x) for w, c, p, x, gt in calls if w == s and c == chrom and a <= p <= b and gt.split("|")[h - 1] == "1"))
                    seq = list(seq)
                    for p, x in own.items():
                        seq[p - a : p - a + 1] = x  # behind the end of the chromosome a letter is added
                    dna, on = dna + "".join(seq), strand
            want[s, f"H{h}_{t}"] = _protein(_on(on, dna))
    assert {(r["sample"], r.id): r.sequence for r in got.collect()} == want


def test_nothing_behind_the_first_stop_is_translated_again(spark, monkeypatch):
    """The time of a run went into translating whole transcripts anew for each variant of each sample."""
    plain = sequence.translate_dna
    whole = lambda dna, least=0: plain(F.when(F.contains(dna, F.lit("GGGGGGGG")), F.raise_error(F.lit("translated"))).otherwise(dna), least)
    monkeypatch.setattr(sequence, "translate_dna", whole)
    seq = "ATGGCCATTGTATGACATCATCATCATCATC"
    one = lambda strand, s: spark.createDataFrame([("c", s, "T", strand)], "chrom string, seq string, transcript_id string, strand string")
    for strand, text, late, early in (("+", seq, 20, 4), ("-", _on("-", seq), 12, 27)):
        rows = one(strand, text)
        tx = rows.select("transcript_id", "chrom", "strand", F.lit("G").alias("gene_id"), F.array(F.struct(F.lit(1).alias("start"), F.lit(len(text)).alias("end"))).alias("exons"))
        found = lambda pos, alt: spark.createDataFrame([("c", pos, text[pos - 1], alt, 1)], "chrom string, pos int, ref string, alt string, ord long")  # noqa: E731, B023
        run = lambda pos, alt: proteome.frameshift_proteins(found(pos, alt), tx, rows.select("chrom", "seq"), 2)  # noqa: E731, B023
        assert [r.sequence for r in run(late, _on(strand, "GGGGGGGG")).collect()] == ["MAIV"]
        with pytest.raises(Exception, match="translated"):
            run(early, _on(strand, "GGGGGGGG")).collect()


def test_frameshift_query_cleans_its_texts_once(spark, sf):
    """Every reader of the genome ran the expression over all texts again."""
    from burdock.plans import registry

    plan = registry.load()[0]["frameshift_proteins"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("run(") == 2  # each protein is computed once, also for the filter
