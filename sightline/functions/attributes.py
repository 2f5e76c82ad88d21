"""Attribute and category predicates on bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.vocab import ATTRIBUTES, EXCLUSIVE


def score(bits: Column, mask: Column) -> Column:
    """Share of the required attributes that are present; 1 where none is required."""
    return F.when(mask == 0, F.lit(1.0)).otherwise(F.bit_count(bits.bitwiseAND(mask)) / F.bit_count(mask))


def all_present(bits: Column, mask: Column) -> Column:
    return bits.bitwiseAND(mask) == mask


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets of attributes; 0 where one is empty."""
    n = F.bit_count(a) * F.bit_count(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / F.sqrt(n.cast("double")))


def in_mask(category: Column, mask: Column, wrap: bool = False) -> Column:
    """Whether a mask array enables the category. wrap: -1 reads the last slot, as indexing from the end would."""
    at = F.when((category < 0) & F.lit(wrap), F.size(mask) + category).otherwise(category)
    return F.coalesce(F.get(mask, at), F.lit(False)) & (at >= 0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def decide(prob: dict[str, Column], threshold: float = 0.5) -> dict[str, Column]:
    """Attribute decisions: the first most probable of each exclusive group, else above the threshold."""
    out = {}
    for group in EXCLUSIVE:
        best = F.greatest(*(prob[g] for g in group))
        taken = F.lit(False)
        for g in group:
            first = (prob[g] == best) & ~taken
            out[g], taken = first, taken | first
    return {a: out.get(a, prob[a] > threshold) for a in ATTRIBUTES if a in prob}
