"""Proteome construction: expressed transcripts, haplotype and frameshift proteins, unions, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence
from ..sources.readers import attribute, binned, slices


def transcripts(features: DataFrame) -> DataFrame:
    """transcript_id, clean_id, gene_id, chrom, strand, exons (sorted start/end structs), cds_bp."""
    rows = features.withColumns({"transcript_id": attribute("transcript_id"), "gene_id": attribute("gene_id")}).where("transcript_id is not null")
    exon = F.when(F.col("feature") == "exon", F.struct("start", "end"))
    out = rows.groupBy("transcript_id").agg(
        F.min("gene_id").alias("gene_id"), F.min("seqname").alias("chrom"), F.min("strand").alias("strand"),
        F.array_sort(F.collect_list(exon)).alias("exons"), F.coalesce(F.sum(F.when(F.col("feature") == "CDS", F.col("end") - F.col("start") + 1)), F.lit(0)).alias("cds_bp"),
    )
    return out.withColumn("clean_id", sequence.strip_version(F.col("transcript_id")))


def expressed_ids(tx: DataFrame, abundance: DataFrame, min_tpm: float = 1.0, min_cds: int = 30, allowed: DataFrame | None = None) -> DataFrame:
    """Sorted ids of transcripts with exons, enough coding length and TPM above ``min_tpm`` under the full or version-free
    id; with ``allowed`` (id), only those on the list under either id."""

    def either(rows, keys):
        return rows.join(keys, F.col("transcript_id") == F.col("k"), "left_semi").unionByName(rows.join(keys, F.col("clean_id") == F.col("k"), "left_semi"))

    fit = tx.where((F.col("cds_bp") >= min_cds) & (F.size("exons") > 0))
    both = either(fit, abundance.where(F.col("tpm") > min_tpm).select(F.col("transcript_id").alias("k")).distinct())
    if allowed is not None:
        both = either(both, allowed.select(F.col("id").alias("k")).distinct())
    return both.select(F.col("transcript_id").alias("id")).distinct().orderBy("id")


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int = 1 << 16) -> DataFrame:
    """Points in closed intervals of the same key: an equi-join on fixed bins, then the exact test. No cross product of a key's rows."""
    bins = F.sequence(F.floor(F.col(start) / width).cast("int"), F.floor(F.col(end) / width).cast("int"))
    left = points.withColumn("__bin", F.floor(F.col(at) / width).cast("int"))
    right = spans.withColumn("__bin", F.explode(bins))
    return left.join(right, [key, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__bin")


def frameshift_variants(variants: DataFrame) -> DataFrame:
    return variants.where((F.length("alt") - F.length("ref")) % 3 != 0)


def on_strand(dna: Column) -> Column:
    return F.when(F.col("strand") == "-", sequence.reverse_complement(dna)).otherwise(dna)


def read_stretch(dna: Column, protein: Column) -> Column:
    """What translation has read of ``dna`` up to its first stop, as it stands on the forward strand; null without a stop.
    Whatever changes behind it, the protein stays."""
    n = 3 * (F.length(protein) + 1)
    return F.when(F.length(dna) >= n, F.when(F.col("strand") == "-", F.right(dna, n)).otherwise(F.left(dna, n)))


def retranslated(rows: DataFrame, dna: str, stretch: str, protein: str) -> DataFrame:
    """``rows`` with ``own``: the protein of the changed ``dna``, which goes. Only where the change reaches the ``stretch``
    is it translated; else it is ``protein``."""
    same = F.coalesce(F.when(F.col("strand") == "-", F.endswith(dna, stretch)).otherwise(F.startswith(dna, stretch)), F.lit(False))
    left = rows.withColumn("__dna", F.when(~same, on_strand(F.col(dna)))).drop(dna, stretch)
    return left.withColumn("own", F.when(F.col("__dna").isNull(), F.col(protein)).otherwise(sequence.translate_dna(F.col("__dna")))).drop("__dna")


def _edited(e: Column) -> Column:
    off = F.col("pos") - e["start"]
    changed = F.concat(F.substring(e["seq"], F.lit(1), off), F.col("alt"), F.substring(e["seq"], off + F.length("ref") + 1, F.length(e["seq"])))
    return F.when((F.col("pos") >= e["start"]) & (F.col("pos") <= e["end"]), changed).otherwise(e["seq"])


def frameshift_proteins(variants: DataFrame, tx: DataFrame, genome: DataFrame, min_aa: int = 6, by: tuple[str, ...] = (), wanted: DataFrame | None = None) -> DataFrame:
    """header, sequence of mutant proteins of indels inside exons; of equal proteins of a gene the first in variant order.

    ``genome`` is (chrom, seq); exons are cut from pieces of it, so no chromosome travels with an exon or a variant.
    ``by``: columns of the variants that keep apart what belongs to different samples; ``wanted`` (by, transcript_id):
    the only transcripts that count. A transcript is translated once, a variant only where it changes what was read of it.
    """
    shifts = frameshift_variants(variants)
    spans = tx.select("transcript_id", "chrom", F.explode("exons").alias("e")).select("transcript_id", "chrom", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    hit = range_join(shifts, spans, "chrom", "pos", "start", "end").select(*by, "transcript_id", "pos", "ref", "alt", "ord").distinct()
    if wanted is not None:
        hit = hit.join(wanted, [*by, "transcript_id"], "left_semi")
    needed = hit.select("transcript_id").distinct()
    cut = slices(binned(genome), spans.join(needed, "transcript_id", "left_semi").join(genome.select("chrom").distinct(), "chrom", "left_semi"))
    exons = cut.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "seq"))).alias("parts"))
    told = exons.join(tx.select("transcript_id", "gene_id", "strand"), "transcript_id").withColumn("__whole", F.array_join(F.col("parts.seq"), ""))
    told = told.withColumn("wt", sequence.translate_dna(on_strand(F.col("__whole")))).withColumn("__read", read_stretch(F.col("__whole"), F.col("wt"))).drop("__whole")
    rows = hit.join(told, "transcript_id").withColumn("__changed", F.array_join(F.transform("parts", _edited), "")).drop("parts")
    rows = retranslated(rows, "__changed", "__read", "wt").withColumnRenamed("own", "mut").where(F.length("mut") >= F.greatest(F.lit(min_aa), F.lit(1)))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by, "gene_id", "mut").orderBy("ord", "transcript_id"))).where("n = 1")
    shift = F.length("alt") - F.length("ref")
    header = F.format_string("FRAMESHIFT_%s_%s type=%s shift=%dbp WT=%d MUT=%d diff=%d", "gene_id", "transcript_id", F.when(shift < 0, "DEL").otherwise("INS"), shift, F.length("wt"), F.length("mut"), F.length("mut") - F.length("wt"))
    return first.select(*by, header.alias("header"), F.col("mut").alias("sequence"), "gene_id", "ord")


def haplotype_proteins(snps: DataFrame, cds: DataFrame, haplotype: int) -> DataFrame:
    """id, sequence with the haplotype's SNP alleles put into each coding slice.

    ``snps`` (chrom, pos, alt, gt), gt like 0|1 or 0/1; ``cds`` (transcript_id, chrom, strand, start, end, seq).
    """
    on = snps.withColumn("allele", F.get(F.split("gt", r"[|/]"), F.lit(haplotype - 1))).where("allele = '1' and length(alt) = 1")
    edits = range_join(on, cds.select("transcript_id", "chrom", "start", "end"), "chrom", "pos", "start", "end").groupBy("transcript_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "alt"))).alias("edits"))
    changed = F.aggregate("edits", F.col("seq"), lambda s, e: F.overlay(s, e["alt"], e["pos"] - F.col("start") + 1))
    parts = cds.join(edits, ["transcript_id", "start"], "left").withColumn("seq", F.when(F.col("edits").isNull(), F.col("seq")).otherwise(changed))
    whole = parts.groupBy("transcript_id").agg(F.min("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"))
    dna = F.array_join(F.transform("p", lambda x: x["seq"]), "")
    return whole.select(F.concat(F.lit(f"H{haplotype}_"), "transcript_id").alias("id"), sequence.translate_dna(F.when(F.col("strand") == "-", sequence.reverse_complement(dna)).otherwise(dna)).alias("sequence"))


def snps(variants: DataFrame, alt: str = "alt", ref: str = "ref") -> DataFrame:
    return variants.withColumn(alt, F.explode(F.split(alt, ","))).where((F.length(ref) == 1) & (F.length(alt) == 1))


def union_distinct(*sets: DataFrame) -> DataFrame:
    """Records of all sets; of equal (id, sequence) the first by set, then by ``ord``."""
    tagged = [s.select("id", "sequence", F.lit(i).alias("file_ord"), "ord") for i, s in enumerate(sets)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("id", "sequence").agg(F.min(F.struct("file_ord", "ord")).alias("o")).select("id", "sequence", "o.file_ord", "o.ord")


def truncations(records: DataFrame, least: int = 10, share: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Transcripts whose two haplotype proteins differ by over ``least`` residues and over ``share`` of the longer; of a repeated id the last counts."""
    named = records.where(F.instr("id", "_") > 0).select(*by, F.substring_index("id", "_", 1).alias("h"), F.expr("substring(id, instr(id, '_') + 1)").alias("TRANSCRIPT_ID"), F.length("sequence").alias("n"), "ord")
    wide = named.groupBy(*by, "TRANSCRIPT_ID").agg(*(F.max_by("n", F.when(F.col("h") == h, F.col("ord"))).alias(f"LEN_{h}") for h in ("H1", "H2")))
    gap, most = F.abs(F.col("LEN_H1") - F.col("LEN_H2")), F.greatest("LEN_H1", "LEN_H2")
    return wide.where((gap > least) & (gap / most > share)).select(*by, "TRANSCRIPT_ID", "LEN_H1", "LEN_H2", F.concat(F.lit("-"), gap).alias("LOSS"), F.when(F.col("LEN_H1") > F.col("LEN_H2"), "H2_TRUNCATED").otherwise("H1_TRUNCATED").alias("STATUS"))


def verify(outputs: dict[str, DataFrame]) -> DataFrame:
    """check, status, message: each output must have rows, none of them empty."""
    rows = None
    for name, df in outputs.items():
        one = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.length(F.col(df.columns[-1]).cast("string")), F.lit(0)) == 0).alias("bad")).select(F.lit(name).alias("check"), F.when((F.col("n") > 0) & (F.col("bad") == 0), "OK").otherwise("ATTENTION").alias("status"), F.format_string("%d rows, %d empty", "n", "bad").alias("message"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def verify_outputs(spark: SparkSession, outputs: dict[str, DataFrame | None]) -> DataFrame:
    """check, status, message of the outputs clean_ids, protein, frameshift, combined and nonsense (None: missing):
    each exists and has rows, and the combined set holds at least as many records as each of its parts."""
    counts = None
    for name, df in outputs.items():
        one = (spark.range(1).select(F.lit(None).cast("long").alias("n")) if df is None else df.agg(F.count("*").alias("n"))).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    row = lambda check, ok, text: F.struct(check.alias("check"), F.when(ok, "OK").otherwise("ATTENTION").alias("status"), text.alias("message"))
    named = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("name"))
    there, some = F.col("n").isNotNull(), F.col("n") > 0
    kinds = F.filter(
        F.array(
            row(named("exists"), there, F.when(there, "output exists").otherwise("output is missing")),
            row(named("nonempty"), some, F.when(some, "output has content").otherwise("output is empty")),
            F.when(F.col("name") != "nonsense", row(named("content"), some, F.format_string("%d records", "n"))),
        ),
        lambda x: x.isNotNull() & (there | x["check"].startswith("exists")),
    )
    each = counts.select(F.explode(kinds).alias("x")).select("x.*")
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("n")))
    whole = counts.agg(*(of(k).alias(k) for k in ("protein", "frameshift", "combined")))
    pairs = [row(F.lit(f"consistency:combined_contains_{k}"), F.col("combined") >= F.col(k), F.format_string(f"combined=%d {k}=%d", "combined", k)) for k in ("protein", "frameshift")]
    held = F.filter(F.array(*(F.when(F.col("combined").isNotNull() & F.col(k).isNotNull(), p) for k, p in zip(("protein", "frameshift"), pairs, strict=True))), lambda x: x.isNotNull())
    return each.unionByName(whole.select(F.explode(held).alias("x")).select("x.*"))


def allele_counts(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """Samples with an allele, by group; ``groups``: sample, grp. Samples without a group count under null."""
    return calls.select("sample", "locus", "allele").distinct().join(groups, "sample", "left").groupBy("grp", "locus", "allele").agg(F.countDistinct("sample").alias("n_samples"))


def truncation_counts(rows: DataFrame, samples: DataFrame, transcript: str = "TRANSCRIPT_ID") -> DataFrame:
    """Rows and distinct version-free transcripts of truncations for every row of ``samples``; zero where there is none."""
    own = rows.groupBy("sample").agg(F.count("*").alias("n_rows"), F.countDistinct(sequence.strip_version(F.col(transcript))).alias("n_transcripts"))
    return samples.join(own, "sample", "left").na.fill(0, ["n_rows", "n_transcripts"])


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with shared, mismatched, left_only or right_only."""
    both = a.select(key, F.col(value).alias("x"), F.lit(True).alias("l")).join(b.select(key, F.col(value).alias("y"), F.lit(True).alias("r")), key, "full_outer")
    return both.select(key, F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(F.col("x").eqNullSafe(F.col("y")), "shared").otherwise("mismatched").alias("state"))


def hla_ranks(calls: DataFrame) -> DataFrame:
    """Calls without repeats; rank is the order of first appearance within sample, caller and locus."""
    first = calls.groupBy("sample", "caller", "locus", "allele").agg(F.min("ord").alias("ord"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("sample", "caller", "locus").orderBy("ord", "allele")))


def hla_consensus(calls: DataFrame, min_support: int = 2, ploidy: int = 2) -> DataFrame:
    """The ``ploidy`` best supported alleles of each sample and locus, with their standing among the callers."""
    by = calls.groupBy("sample", "locus", "allele").agg(F.collect_set("caller").alias("c"), F.min(F.coalesce("rank", F.lit(999))).alias("r"), F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("source_files"))
    callers = calls.groupBy("sample", "locus").agg(F.countDistinct("caller").alias("caller_count"))
    place = Window.partitionBy("sample", "locus")
    top = by.withColumn("support_count", F.size("c")).withColumn("n", F.row_number().over(place.orderBy(F.desc("support_count"), "r", "allele"))).where(F.col("n") <= ploidy)
    top = top.withColumn("some", F.max("support_count").over(place) >= min_support).join(callers, ["sample", "locus"])
    status = F.when(F.col("support_count") >= min_support, "CONSENSUS").when(F.col("caller_count") <= 1, "SINGLE_CALLER").when(F.col("some"), "LOW_SUPPORT").otherwise("CONFLICT")
    return top.select("sample", "locus", "allele", status.alias("consensus_status"), "support_count", F.array_join(F.array_sort("c"), ",").alias("support_callers"), "caller_count", "source_files")
