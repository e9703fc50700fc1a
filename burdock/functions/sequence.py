"""Sequence functions on string columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GROUPS, RESIDUES
from . import codons


def clean(s: Column) -> Column:
    """Upper case, standard residues only."""
    return F.regexp_replace(F.upper(s), f"[^{RESIDUES}]", "")


def dashed(s: Column) -> Column:
    """Upper case, anything else a dash."""
    return F.regexp_replace(F.upper(s), f"[^{RESIDUES}-]", "-")


def scan_status(cleaned: Column, least: int = 6) -> Column:
    return F.when(F.length(cleaned) == 0, F.lit("empty_after_cleaning")).when(F.length(cleaned) < least, F.lit(f"shorter_than_{least}")).otherwise(F.lit("ok"))


def groups(cleaned: Column) -> Column:
    """Residues as group digits 0 to 5."""
    return F.translate(cleaned, "".join(GROUPS), "".join(str(i) * len(g) for i, g in enumerate(GROUPS)))


def sixmer_code(six: Column) -> Column:
    return F.conv(six, 6, 10).cast("int")


def sixmer_text(code: Column) -> Column:
    return F.lpad(F.conv(code.cast("string"), 10, 6), 6, "0")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not again for every element of a lambda inside."""
    return F.transform(F.array(value), body)[0]


def _each(count: Column, body, kind: str) -> Column:
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), body)).otherwise(F.array().cast(f"array<{kind}>"))


def windows(s: Column, size: int) -> Column:
    """All substrings of ``size`` letters; none of a shorter text. Letters are picked from an array: a substring of a
    string is found by walking from its start."""
    return bound(F.split(s, ""), lambda c: _each(F.size(c) - size + 1, lambda i: F.concat(*(c[i + k] for k in range(size))), "string"))


def sixmer_codes(cleaned: Column) -> Column:
    digits = F.transform(F.filter(F.split(groups(cleaned), ""), lambda x: x != ""), lambda x: x.cast("int"))
    return bound(digits, lambda c: _each(F.size(c) - 5, lambda i: sum((c[i + k] * 6 ** (5 - k) for k in range(1, 6)), c[i] * 6**5), "int"))


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(F.upper(dna), "ACGTN", "TGCAN"))


def translate_dna(dna: Column, least: int = 0) -> Column:
    """Frame 0 up to the first stop; unknown codons are X; empty if shorter than ``least``. An Arrow pass, so not for lambdas."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return codons.proteins(texts)

    protein = run.asNondeterministic()(F.upper(dna))  # else a filter on the protein translates anew
    return F.when(F.length(protein) >= least, protein).otherwise(F.lit("")) if least else protein


def cut_stops(s: Column) -> Column:
    """Up to the first '.'; null if there are several or nothing is left."""
    return F.when((F.length(s) - F.length(F.replace(s, F.lit("."))) <= 1) & (F.substring_index(s, ".", 1) != ""), F.substring_index(s, ".", 1))


def strip_version(s: Column) -> Column:
    return F.substring_index(s, ".", 1)


def transcript_id(s: Column) -> Column:
    """Ensembl transcript id inside a text, without its version; null if there is none."""
    return F.nullif(F.regexp_extract(s, r"ENST\d+", 0), F.lit(""))


def protein_class(header: Column) -> Column:
    return F.when(header.startswith("H1_"), "haplotype_1").when(header.startswith("H2_"), "haplotype_2").when(header.startswith("FRAMESHIFT_"), "frameshift").otherwise("other")


def odd_residues(s: Column) -> Column:
    """Distinct letters outside the standard alphabet, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.split(s, "")), F.array(*map(F.lit, RESIDUES + ""))))


def wrap(s: Column, width: int = 80) -> Column:
    return F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n")


#: Allele name: locus, star, two to four fields.
HLA = r"(?:HLA[-_])?([A-Z0-9]+)\*([0-9]{2,3}(?::[0-9A-Z]{2,3}){1,3})"


def normal_locus(s: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.translate(F.upper(F.trim(s)), "_", "-"), "^HLA-", ""), "*", 1)


def normal_allele(s: Column) -> Column:
    """Canonical name, HLA-locus*fields; null if there is none."""
    up = F.translate(F.upper(F.trim(s)), "_", "-")
    return F.when(F.regexp_extract(up, HLA, 1) != "", F.concat(F.lit("HLA-"), F.regexp_extract(up, HLA, 1), F.lit("*"), F.regexp_extract(up, HLA, 2)))


def allele_locus(allele: Column) -> Column:
    return F.regexp_extract(allele, r"^HLA-([A-Z0-9]+)\*", 1)


def odd_share(s: Column) -> Column:
    """Share of letters outside the standard alphabet; null for an empty text."""
    return 1 - F.length(F.regexp_replace(F.upper(s), f"[^{RESIDUES}]", "")) / F.nullif(F.length(F.upper(s)), F.lit(0))


def exploded(s: Column, most: float = 0.05) -> Column:
    """Whether over ``most`` of a sequence's letters are not residues."""
    return F.coalesce(odd_share(s) > most, F.lit(False))
