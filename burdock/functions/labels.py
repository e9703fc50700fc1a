"""Prediction labels, consensus rules and probability classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASS_ORDER, CONSENSUS_ORDER, NEGATIVE, POSITIVE


def label(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p > threshold, POSITIVE).when(p.isNotNull(), NEGATIVE)


def normal(x: Column) -> Column:
    """Amyloid or Non-Amyloid for the known spellings, NA for missing, anything else in lower case as it is."""
    low = F.translate(F.lower(F.trim(x)), "_", "-")
    return F.when(F.coalesce(low, F.lit("")) == "", "NA").when(low.isin("amyloid", "amyloidogenic", "amyl"), "Amyloid").when(low.isin("non-amyloid", "non amyloid", "nonamyloid", "not-amyloid"), "Non-Amyloid").otherwise(low)


def consensus(*labels: Column) -> Column:
    """All present and equal: the label; equal but some missing: Partial; different: Discordant; none: NA."""
    present = F.filter(F.array(*labels), lambda x: x.isNotNull() & (x != "NA"))
    kinds = F.size(F.array_distinct(present))
    return F.when(kinds == 0, "NA").when(kinds > 1, "Discordant").when(F.size(present) == len(labels), present[0]).otherwise("Partial")


def by_cuts(p: Column, cuts: tuple[float, float], strict: bool = False) -> Column:
    low, high = cuts
    top, bottom = (p > high, p < low) if strict else (p >= high, p <= low)
    return F.when(top, CLASS_ORDER[0]).when(bottom, CLASS_ORDER[2]).when(p.isNotNull(), CLASS_ORDER[1])


def joint(a: Column, b: Column) -> Column:
    """Both extreme alike, else Intermediate; null where one is."""
    return F.when(a.isNull() | b.isNull(), None).when((a == b) & (a != CLASS_ORDER[1]), a).otherwise(CLASS_ORDER[1])


def first_of(values: Column, order: tuple[str, ...] = CONSENSUS_ORDER) -> Column:
    """Aggregate: the value that comes first in ``order``."""
    ranks = F.array(*map(F.lit, order))
    place = F.array_position(ranks, values)
    return F.try_element_at(ranks, F.min(F.when(place > 0, place)).cast("int"))


def as_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def keyword_flags(cols: list[str], flags: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """By flag, whether any of its words occurs in any of the texts, in either case; a null text holds none."""
    text = F.lower(F.concat_ws(";", *cols))
    found = lambda words: F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(text, w))
    return {k: found(words) for k, words in flags.items()}


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """``x`` kept between the bounds; null stays null."""
    out = x if low is None else F.greatest(x, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def coding_only(value: Column, biotype: Column, fill: str | None = None) -> Column:
    """A class of protein-coding transcripts; null for others, ``fill`` where a coding one has none."""
    return F.when(biotype == "protein_coding", value if fill is None else F.coalesce(value, F.lit(fill)))


def with_fallback(new: Column, old: Column, other: Column, both_missing: str = "Partial") -> Column:
    """Consensus of a predictor (its older call where it has none) and another: agreed, Discordant, or Partial."""
    a = F.coalesce(F.nullif(new, F.lit("NA")), F.nullif(old, F.lit("NA")))
    b = F.nullif(other, F.lit("NA"))
    return F.when(a.isNull() & b.isNull(), F.lit(both_missing)).when(a.isNull() | b.isNull(), "Partial").when(a == b, a).otherwise("Discordant")
