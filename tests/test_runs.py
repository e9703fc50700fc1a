"""Runs over a sample sheet: parameters, samples without inputs, keyed steps, resumed steps."""

import json

import numpy as np
import pytest
from burdock.operators import runs
from burdock.sources import readers
from pyspark.sql import functions as F

GENOME = "ATGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG"
HEAD = "##m\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"


@pytest.fixture
def cohort_files(tmp_path):
    gtf = "".join(f'chrF\tx\t{f}\t1\t39\t.\t+\t.\tgene_id "G"; transcript_id "ENST{i}.2";\n' for i in (1, 2) for f in ("transcript", "exon", "CDS"))
    files = {
        "a.gtf": "#c\n" + gtf, "g.fa": f">chrF\n{GENOME}\n", "table.json": json.dumps(np.linspace(0, 1, 6**6).tolist()),
        "one.tsv": "target_id\tlength\teff_length\test_counts\ttpm\nENST1|g\t30\t20\t1\t10.0\nENST2.2\t30\t20\t1\t0.5\n",
        "two.tsv": "target_id\tlength\teff_length\test_counts\ttpm\nENST1.2\t30\t20\t1\t3\nENST2.2\t30\t20\t1\t4\nENST9.2\t30\t20\t1\t4\n",
        "one.vcf": HEAD + "chrF\t4\t.\tG\tA,T\t.\t.\t.\tDP:GT\t7:0|1\nchrF\t10\t.\tG\tGT,GC\t.\t.\t.\tGT\t0/1\n",
        "two.vcf": HEAD + "chrF\t4\t.\tG\tA,T\t.\t.\t.\tGT:DP\t2|1:9\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = ["sample_id,abundance,vcf", f"s1,{tmp_path}/one.tsv,{tmp_path}/one.vcf", f"s2,{tmp_path}/two.tsv,{tmp_path}/two.vcf", f"s3,{tmp_path}/two.tsv,{tmp_path}/none.vcf", f"s4,,{tmp_path}/two.vcf"]
    (tmp_path / "samples.csv").write_text("\n".join(rows) + "\n")
    return tmp_path


def _params(at, **kw):
    return runs.Parameters(**{"mode": "prepared", "outdir": f"{at}/out", "samples": f"{at}/samples.csv", "ref_genome": f"{at}/g.fa", "ref_gtf": f"{at}/a.gtf", "sixmer_table": f"{at}/table.json", "top_k": 1} | kw)


@pytest.mark.parametrize(("change", "word"), [({"mode": "full"}, "unsupported mode"), ({"samples": ""}, "needs samples"), ({"min_tpm": -1.0}, "min_tpm"), ({"min_cds_bp": 0}, "min_cds_bp"), ({"min_frameshift_aa": 0}, "min_frameshift_aa"), ({"min_cds_bp": "3"}, "must be a int"), ({"top_k": -1}, "top_k"), ({"threshold": 2.0}, "threshold"), ({"mode": "amyloid"}, "needs input_fasta")])
def test_bad_parameters_are_refused_before_anything_is_read(tmp_path, change, word):
    with pytest.raises(ValueError, match=word):
        runs.run(None, _params(tmp_path, **change))  # without a session nothing could be read


def test_prepared_run_of_all_samples(spark, cohort_files):
    out = runs.run(spark, _params(cohort_files))
    held = lambda name, *cols: sorted(map(tuple, out[name].select(*cols).collect()))
    assert held("clean_ids", "sample", "transcript_id") == [("s1", "ENST1.2"), ("s2", "ENST1.2"), ("s2", "ENST2.2")]
    plain, a, t = "MAIVMGR", "MTIVMGR", "MSIVMGR"
    assert held("proteins", "sample", "id", "sequence") == [
        ("s1", "H1_ENST1.2", plain), ("s1", "H2_ENST1.2", a),
        ("s2", "H1_ENST1.2", t), ("s2", "H1_ENST2.2", t), ("s2", "H2_ENST1.2", a), ("s2", "H2_ENST2.2", a),
    ]
    ((who, header, protein),) = held("frameshifts", "sample", "id", "sequence")
    assert who == "s1" and header.startswith("FRAMESHIFT_G_ENST1.2 type=INS") and protein == "MAIVNGPLKGCPI"
    assert out["combined"].count() == 7 and out["predictions"].where("status = 'ok'").count() == 7 and out["features"].count() == 7 and out["top"].count() == 2
    states = {(r["sample"], r["step"]): (r.status, r.n, r.message) for r in out["states"].collect()}
    assert len(states) == 4 * 6 and states["s1", "combined"] == ("OK", 3, "3 rows") and states["s2", "frameshifts"] == ("ATTENTION", 0, "0 rows")
    assert states["s3", "clean_ids"] == ("SKIP", 0, "missing: vcf") and states["s4", "proteins"] == ("SKIP", 0, "missing: abundance")
    one = {r["id"]: r.prob for r in out["predictions"].where("sample = 's1'").collect()}
    two = {r["id"]: r.prob for r in out["predictions"].where("sample = 's2'").collect()}
    assert one["H2_ENST1.2"] == two["H2_ENST1.2"]


def test_resume_reads_finished_steps_and_makes_the_others(spark, cohort_files, monkeypatch):
    params = _params(cohort_files, top_k=0, run_protein_features=False)
    first = {k: sorted(map(str, v.collect())) for k, v in runs.run(spark, params).items()}
    made = []
    plain = runs.Tables.step

    def step(self, name, make):
        return plain(self, name, lambda: made.append(name) or make())

    monkeypatch.setattr(runs.Tables, "step", step)
    (cohort_files / "out/proteins/_SUCCESS").unlink()  # as if the run had stopped there
    again = {k: sorted(map(str, v.collect())) for k, v in runs.run(spark, params, resume=True).items()}
    assert again == first and made == ["proteins", "states"]
    made.clear()
    runs.run(spark, _params(cohort_files, top_k=0, run_protein_features=False, min_tpm=3.5), resume=True)
    assert "clean_ids" in made and "proteins" in made  # other parameters: nothing is taken over


def test_amyloid_run_of_a_folder(spark, cohort_files, tmp_path):
    folder = tmp_path / "fastas"
    folder.mkdir()
    (folder / "x.fasta").write_text(">p1\nVQIVYKACD\n>p2\nACD\n")
    (folder / "y.fa").write_text(">p1\nACDEFGHIK\n")
    out = runs.run(spark, runs.Parameters("amyloid", outdir=f"{tmp_path}/o", input_fasta=str(folder), sixmer_table=f"{cohort_files}/table.json"))
    assert sorted((r["sample"], r["id"], r.status) for r in out["predictions"].collect()) == [("x", "p1", "ok"), ("x", "p2", "shorter_than_6"), ("y", "p1", "ok")]
    assert {(r["sample"], r.status) for r in out["states"].collect()} == {("x", "OK"), ("y", "OK")}


def test_sheets_that_cannot_be_run(spark, tmp_path):
    (tmp_path / "no.csv").write_text("sample_id,vcf\na,b\n")
    (tmp_path / "twice.csv").write_text("sample_id,abundance,vcf\na,x,y\na,x,y\n")
    for name, word in (("no", "lacks abundance"), ("twice", "twice")):
        with pytest.raises(ValueError, match=word):
            runs.sheet(spark, f"{tmp_path}/{name}.csv")
    empty = runs.of_samples(spark, spark.createDataFrame([], "sample string, vcf string"), "vcf", lambda p: readers.calls(spark, p))
    assert empty.count() == 0 and empty.select(F.col("sample")).schema[0].dataType.simpleString() == "string"


def test_run_command(spark, cohort_files):
    from burdock.__main__ import main

    p = _params(cohort_files)
    args = ["run", "--mode", "prepared", "--samples", p.samples, "--ref-genome", p.ref_genome, "--ref-gtf", p.ref_gtf, "--sixmer-table", p.sixmer_table, "--outdir", f"{cohort_files}/cli", "--run-protein-features", "false"]
    assert main(args, spark) == 2 and main([*args, "--resume"], spark) == 2  # two samples lack an input
    assert spark.read.parquet(f"{cohort_files}/cli/combined").count() == 7
    with pytest.raises(ValueError, match="min_tpm"):
        main([*args, "--min-tpm", "-1"], spark)
