"""The command line on small files."""

import json

import numpy as np
import pytest
from burdock.__main__ import main
from burdock.operators import scoring
from burdock.sources import models, readers

GENOME = "ATGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG"


def read(spark, path, sep="\t"):
    return [r.asDict() for r in spark.read.csv(str(path), sep=sep, header=True).collect()]


@pytest.fixture
def files(tmp_path):
    gtf = [f'chrF\tx\t{f}\t1\t39\t.\t+\t.\tgene_id "G"; transcript_id "ENST1.2";' for f in ("transcript", "exon", "CDS")]
    for name, text in {
        "a.gtf": "# c\n" + "\n".join(gtf) + "\n",
        "a.tsv": "target_id\tlength\teff_length\test_counts\ttpm\nENST1.2|g\t30\t20\t100\t10.0\n",
        "g.fa": f">chrF\n{GENOME}\n",
        "v.vcf": "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nchrF\t10\t.\tG\tGT\t.\t.\t.\tGT\t0/1\n",
        "p.fa": ">s1 x\nVQIVYKACD\n>bad\nACD\n>none\n***\n>s2\nACDEFG.HHH\n",
        "h.fa": ">H1_T1\n" + "A" * 50 + "\n>H2_T1\n" + "A" * 20 + "\n>H1_T2\nAAA\n",
        "calls.json": json.dumps({"A": ["A*02:01", "HLA-A*24:02"]}), "calls.tsv": "A1\tA2\nA*02:01\tA*03:01\n",
    }.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_proteome_commands(spark, files):
    run = lambda *args: main([str(files / x[1:]) if str(x).startswith("@") else x for x in args], spark)
    run("clean-ids", "--gtf", "@a.gtf", "--abundance", "@a.tsv", "--out", "@ids")
    assert [r.value for r in spark.read.text(str(files / "ids")).collect()] == ["ENST1.2"]
    run("frameshifts", "--vcf", "@v.vcf", "--gtf", "@a.gtf", "--genome", "@g.fa", "--ids", "@ids", "--out", "@shift")
    (one,) = readers.fasta(spark, str(files / "shift")).collect()
    assert one.header.startswith("FRAMESHIFT_G_ENST1.2 type=INS shift=1bp") and one.sequence == "MAIVNGPLKGCPI"
    run("clean-proteins", "--input", "@p.fa", "--out", "@clean")
    assert {r.id: r.sequence for r in readers.fasta(spark, str(files / "clean")).collect()}["s2"] == "ACDEFG"
    run("combine", "@p.fa", "@missing.fa", "@p.fa", "@h.fa", "--out", "@both")
    assert readers.fasta(spark, str(files / "both")).count() == 7
    run("nonsense-report", "--input", "@h.fa", "--out", "@cut")
    assert read(spark, files / "cut") == [{"TRANSCRIPT_ID": "T1", "LEN_H1": "50", "LEN_H2": "20", "LOSS": "-30", "STATUS": "H2_TRUNCATED"}]
    assert run("verify", "@h.fa", "--out", "@ok") == 0 and run("verify", "@h.fa", "@missing.fa", "--out", "@not") == 2


def test_hla_commands(spark, files):
    for caller, name in (("json", "calls.json"), ("wide", "calls.tsv")):
        main(["hla-normalize", "--caller", caller, "--sample", "s", "--input", str(files / name), "--out", str(files / f"n_{caller}")], spark)
    main(["hla-consensus", str(files / "n_json"), str(files / "n_wide"), "--out", str(files / "c")], spark)
    got = read(spark, files / "c")
    assert [(r["allele"], r["consensus_status"], r["support_count"]) for r in got][0] == ("HLA-A*02:01", "CONSENSUS", "2") and len(got) == 2


def test_table_and_prediction(spark, files):
    names = ["1_0", "3.6_0", "3.3_1", "3.6.3_0.0"]
    export = {
        "imp_features": names, "independent_variable_names": [f"X{n}" for n in names], "enc": {str(i): [] for i in range(1, 7)},
        "forest": {"num_trees": 1, "child_node_ids": [[[1, 0, 0], [2, 0, 0]]], "split_var_ids": [[4, 0, 0]], "split_values": [[0.5, 0, 0]], "terminal_class_counts": [[[], [9, 1], [2, 8]]]},
    }
    (files / "m.json").write_text(json.dumps(export))
    main(["build-table", "--model", str(files / "m.json"), "--features", "4", "--magic", "SIX", "--out", str(files / "t.bin")], spark)
    main(["build-table", "--model", str(files / "m.json"), "--features", "4", "--out", str(files / "t.json")], spark)
    table = np.array(readers.lookup_table(spark, str(files / "t.bin")))
    assert table.tolist() == readers.lookup_table(spark, str(files / "t.json"))
    has = [any(d[i : i + 3].tolist() == [2, 5, 2] for i in range(4)) for d in scoring.sixmer_digits()]
    assert np.allclose(table, np.where(has, 0.8, 0.1))
    with pytest.raises(ValueError):
        models.forest(export)
    main(["predict", "--input", str(files / "p.fa"), "--sixmer-table", str(files / "t.bin"), "--out", str(files / "pred"), "--top-k", "1", "--top-tsv", str(files / "top"), "--skipped-tsv", str(files / "skip"), "--report-json", str(files / "rep")], spark)
    assert {r["Sequence_ID"]: (r["Prob"], r["Pred"]) for r in read(spark, files / "pred", ",")} == {"s1": ("0.8", "AMYLOID"), "s2": ("0.1", "Non-Amyloid")}
    assert read(spark, files / "top") == [{"Rank": "1", "Sequence_ID": "s1", "Prob": "0.8", "Pred": "AMYLOID"}]
    assert {(r["Sequence_ID"], r["Raw_Length"], r["Reason"]) for r in read(spark, files / "skip")} == {("bad", "3", "shorter_than_6"), ("none", "3", "empty_after_cleaning")}
    assert json.loads(spark.read.text(str(files / "rep")).first().value)["predicted"] == 2
