"""Numeric descriptors of cleaned protein sequences, as expressions over letter counts and positions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALPHA, AROMATIC, BETA, CHARGE, CODONS, COMPOSITION_GROUPS, CTD, HYDROPATHY, RESIDUES, TRIAD_GROUPS
from .sequence import bound, windows


def count(s: Column, letters: str) -> Column:
    """Letters of ``s`` that are in ``letters``."""
    return F.length(s) - F.length(F.translate(s, letters, ""))


def fraction(s: Column, letters: str) -> Column:
    return count(s, letters) / F.nullif(F.length(s), F.lit(0))


def mean_of(s: Column, scale: dict[str, float]) -> Column:
    return reduce(add, (F.lit(v) * count(s, k) for k, v in sorted(scale.items()))) / F.nullif(F.length(s), F.lit(0))


def light(s: Column) -> dict[str, Column]:
    """Length, hydropathy mean, max and sd (population), net charge and density, aromatic, alpha and beta shares, mean + sd score."""
    n = F.length(s)
    mean = mean_of(s, HYDROPATHY)
    square = mean_of(s, {k: v * v for k, v in HYDROPATHY.items()})
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    charge = reduce(add, (F.lit(v) * count(s, k) for k, v in sorted(CHARGE.items())))
    top = F.greatest(*(F.when(count(s, k) > 0, F.lit(v)) for k, v in HYDROPATHY.items()))
    return {
        "protein_length": n, "KD_mean": mean, "KD_max": top, "KD_sd": sd, "charge": charge, "charge_density": charge / F.nullif(n, F.lit(0)),
        "aromaticity": fraction(s, AROMATIC), "alpha_propensity": fraction(s, ALPHA), "beta_propensity": fraction(s, BETA), "chameleon_score": F.abs(mean) + sd,
    }


def aac(s: Column) -> Column:
    return F.array(*(fraction(s, r) for r in RESIDUES))


def gaac(s: Column) -> dict[str, Column]:
    return {k: fraction(s, g) for k, g in COMPOSITION_GROUPS.items()}


def ctdc(s: Column) -> dict[str, Column]:
    """Composition of each property's classes; the third is what the others leave."""
    out = {}
    for p, (a, b, _) in CTD.items():
        out |= {f"{p}_1": fraction(s, a), f"{p}_2": fraction(s, b), f"{p}_3": F.lit(1.0) - fraction(s, a) - fraction(s, b)}
    return out


def classes(s: Column, parts: tuple[str, ...]) -> Column:
    return F.translate(s, "".join(parts), "".join(str(i + 1) * len(g) for i, g in enumerate(parts)))


def _in(*values: str):
    return lambda x: x.isin(*values)


def _places(c: str):
    return lambda x, i: F.when(x == c, i + 1)


def ctdt(s: Column) -> dict[str, Column]:
    """Share of neighbouring pairs that change between two classes, either way."""
    out = {}
    for p, parts in CTD.items():
        pairs = windows(classes(s, parts), 2)
        for a, b in (("1", "2"), ("1", "3"), ("2", "3")):
            out[f"{p}_{a}{b}"] = F.size(F.filter(pairs, _in(a + b, b + a))) / F.nullif(F.length(s) - 1, F.lit(0))
    return out


def ctdd(s: Column) -> dict[str, Column]:
    """Place, in percent of the length, of a class's first residue and of those at a quarter, half, three quarters and the end; 0 if absent."""
    out = {}
    for p, parts in CTD.items():
        digits = F.split(classes(s, parts), "")
        for c in ("1", "2", "3"):
            at = F.filter(F.transform(digits, _places(c)), lambda x: x.isNotNull())
            for q in (0, 25, 50, 75, 100):
                k = F.greatest(F.floor(F.size(at) * q / 100).cast("int"), F.lit(1))
                out[f"{p}_{c}_{q}"] = F.when(F.size(at) > 0, F.try_element_at(at, k) * 100.0 / F.length(s)).otherwise(0.0)
    return out


def dpc(s: Column) -> Column:
    """Map from each pair of residues present to its share of all pairs."""
    share = lambda x: F.transform(F.array_sort(F.array_distinct(x)), lambda k: F.struct(k, F.size(F.filter(x, lambda y: y == k)) / F.size(x)))
    return F.map_from_entries(bound(windows(s, 2), share))


def dde(s: Column, pair: str) -> Column:
    """Deviation of a pair's share from what its codons lead one to expect."""
    codons = {r: sum(v == r for v in CODONS.values()) for r in RESIDUES}
    mean = codons[pair[0]] / 61 * codons[pair[1]] / 61
    n = F.length(s) - 1
    share = F.size(F.filter(windows(s, 2), lambda x: x == pair)) / F.nullif(n, F.lit(0))
    return (share - mean) / F.sqrt(F.lit(mean * (1 - mean)) / F.nullif(n, F.lit(0)))


def triads(s: Column) -> Column:
    """Map from each triad of residue groups present to (count - least) / most over all 343 triads."""
    counted = lambda x: F.transform(F.array_sort(F.array_distinct(x)), lambda k: F.struct(k.alias("k"), F.size(F.filter(x, lambda y: y == k)).alias("n")))
    least = lambda e: F.when(F.size(e) == 343, F.array_min(F.transform(e, lambda z: z["n"]))).otherwise(0)
    scaled = lambda e: F.transform(e, lambda z: F.struct(z["k"], (z["n"] - least(e)) / F.array_max(F.transform(e, lambda y: y["n"]))))
    return F.map_from_entries(bound(bound(windows(classes(s, TRIAD_GROUPS), 3), counted), scaled))


def sliding_means(values: Column, width: int = 7) -> Column:
    """Means of all whole windows of an array."""
    mean = lambda v, i: reduce(add, (v[i + k] for k in range(width))) / width
    every = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - width), lambda i: mean(v, i))
    return bound(values, lambda v: F.when(F.size(v) >= width, every(v)).otherwise(F.array().cast("array<double>")))


def scale_values(s: Column, scale: dict[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in scale.items() for x in pair))
    return F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda r: F.try_element_at(table, r))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log10(F.abs(x) + 1)
