"""Readers and writers of sample sheets, annotations, reports and folders on small files."""

import hashlib

from burdock.__main__ import main
from burdock.operators import proteome
from burdock.sources import readers, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_sample_sheets(spark, tmp_path):
    sheet = put(tmp_path, "s.csv", "sample_id,abundance,vcf,x\na,1.tsv,1.vcf,\nb,,2.vcf,\n,3.tsv,3.vcf,\nc,4.tsv,4.vcf,z\n")
    assert [r.sample_id for r in readers.manifest(spark, sheet).collect()] == ["a", "c"]
    lines = put(tmp_path, "s.txt", "# head\n  s2 \n\ns1\ns2\n#s3\n")
    assert [r.id for r in readers.sample_list(spark, lines).orderBy("ord").collect()] == ["s2", "s1"]


def test_annotation_takes_the_first_row_of_a_transcript(spark, tmp_path):
    row = lambda f, attrs: f"chrM\tx\t{f}\t1\t9\t.\t+\t.\t{attrs}"
    gtf = put(tmp_path, "a.gtf", "\n".join(["# c", row("exon", 'transcript_id "ENST9.1";'), row("transcript", 'gene_id "G1.1"; transcript_id "ENST1.2"; gene_name "N"; transcript_type "protein_coding";'), row("transcript", 'gene_id "G2"; transcript_id "ENST1.3";'), row("transcript", 'gene_id "G3"; transcript_id "ENST2.1";')]) + "\n")
    assert sorted(map(tuple, readers.annotation(spark, gtf).collect())) == [("ENST1", "G1.1", "N", "protein_coding"), ("ENST2", "G3", None, None)]
    main(["annotation", "--gtf", gtf, "--out", str(tmp_path / "ann")], spark)
    assert spark.read.csv(str(tmp_path / "ann"), sep="\t", header=True).count() == 2


def test_tolerant_readers(spark, tmp_path):
    kv = put(tmp_path, "k.tsv", "\ufeffmetric\tvalue\na\t1\nb\t\na\t2\n")
    assert {r.metric: r.value for r in readers.key_values(spark, kv).collect()} == {"a": "2"}
    assert readers.key_values(spark, str(tmp_path / "none")).count() == 0 and readers.skipped(spark, str(tmp_path / "none")).columns[-1] == "Reason"
    rep = put(tmp_path, "r.json", '{"total": 3,\n "mean": 0.5}')
    assert readers.report(spark, rep, "total int, mean double").first().mean == 0.5 and readers.report(spark, str(tmp_path / "none"), "total int").count() == 0
    head = "sample\tcaller\tlocus\tallele\trank\tsource_file\n"
    one = put(tmp_path, "h1.tsv", head + "s\tx\thla_a\tHLA-A*01:01\t\tf\ns\tx\tB\tHLA-B*07:02\tq\tf\n\tx\tB\tHLA-B*07:02\t1\tf\n")
    got = readers.normalized_hla(spark, one, str(tmp_path / "none")).collect()
    assert [(r.locus, r.allele, r["rank"], r.source_file) for r in got] == [("A", "HLA-A*01:01", 999, "f")]
    assert readers.normalized_hla(spark, str(tmp_path / "none")).count() == 0
    wide = put(tmp_path, "w.txt", "A1,A2\nA*01:01,A*02:01\n")
    assert readers.delimiter(spark, wide) == "," and readers.hla_table(spark, wide, "s", "c").count() == 2


def test_genome_slices(spark):
    seq = "".join("ACGT"[i * i % 4] for i in range(1000))
    spans = spark.createDataFrame([("c", a, b) for a, b in ((1, 1), (1, 1000), (64, 65), (65, 128), (900, 999))], "chrom string, start int, end int")
    pieces = readers.binned(spark.createDataFrame([("c", seq)], "chrom string, seq string"), 64)
    assert all(r.seq == seq[r.start - 1 : r.end] for r in readers.slices(pieces, spans, 64).collect()) and readers.slices(pieces, spans, 64).count() == 5
    odd = spark.createDataFrame([("c", 5, 9), ("c", 5, 9), ("c", 990, 1200), ("c", 5000, 5009), ("none", 1, 9)], "chrom string, start int, end int")
    assert sorted((r.chrom, r.start, r.seq) for r in readers.slices(pieces, odd, 64).collect()) == [("c", 5, seq[4:9]), ("c", 5, seq[4:9]), ("c", 990, seq[989:]), ("c", 5000, ""), ("none", 1, "")]


def test_reports_and_run_tables(spark, tmp_path):
    a = spark.createDataFrame([("x", 0.9, "AMYLOID"), ("y", 0.1, "Non-Amyloid")], "Sequence_ID string, prob double, pred string")
    b = spark.createDataFrame([("x", 0.8, "amyl")], "Sequence_ID string, prob double, pred string")
    both = writers.combined({"a": a, "b": b})
    assert [(r.Sequence_ID, r.consensus) for r in both.collect()] == [("x", "Amyloid"), ("y", "Partial")]
    assert {r.metric: r.value for r in writers.run_summary(a, {"a": a, "b": b}, both, sample="s").collect()} == {"sample": "s", "input_records": "2", "a_rows": "2", "b_rows": "1", "combined_rows": "2"}
    assert {r.predictor: r.status for r in writers.run_status({"a": a, "c": a.limit(0), "b": None}).collect()} == {"a": "OK", "c": "ATTENTION", "b": "SKIP"}
    row = spark.createDataFrame([(2, 0.5, None)], "total int, mean double, id string")
    assert [r.value for r in writers.markdown(row, "T", {"In": "f"}).collect()] == ["# T", "", "## Inputs", "", "- In: `f`", "", "## Metrics", "", "| Metric | Value |", "|---|---:|", "| total | 2 |", "| mean | 0.500000 |", "| id |  |"]
    path = put(tmp_path, "f.bin", "abc")
    assert readers.file_digests(spark, path).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_folder_is_verified_by_content(spark, tmp_path):
    for name, text in {"clean_ids.txt": "a\n", "protein.fasta": ">a\nMK\n>b\nMK\n", "frameshift_unique.fasta": ">c\nM\n", "combine_proteome.fasta": ">a\nMK\n>b\nMK\n>c\nM\n", "nonsense_candidates.txt": "h\n"}.items():
        put(tmp_path, name, text)
    assert main(["verify-outputs", "--dir", str(tmp_path), "--out", str(tmp_path / "v1")], spark) == 0
    put(tmp_path, "combine_proteome.fasta", ">a\nMK\n")
    assert main(["verify-outputs", "--dir", str(tmp_path), "--out", str(tmp_path / "v2")], spark) == 2
    bad = {r.check for r in spark.read.csv(str(tmp_path / "v2"), sep="\t", header=True).collect() if r.status != "OK"}
    assert bad == {"consistency:combined_contains_protein"}
    ids = spark.createDataFrame([("T1.1",), ("T2",)], "id string")
    tx = spark.createDataFrame([("T1.1", "T1", 40, [1]), ("T2.5", "T2", 40, [1]), ("T3.1", "T3", 40, [1])], "transcript_id string, clean_id string, cds_bp int, exons array<int>")
    tpm = spark.createDataFrame([("T1", 5.0), ("T2.5", 5.0), ("T3", 5.0)], "transcript_id string, tpm double")
    assert [r.id for r in proteome.expressed_ids(tx, tpm, allowed=ids).collect()] == ["T1.1", "T2.5"]


def test_attribute_runs_its_pattern_once(spark):
    rows = spark.createDataFrame([('gene_id "A"; my_gene_id "B"; gene_id "C";',), ('x "A";',), (None,)], "attribute string").select(readers.attribute("gene_id").alias("g"))
    assert [r.g for r in rows.collect()] == ["C", None, None]
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
