"""Set similarities of token arrays as native column expressions.  All results are DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(a: Column) -> Column:
    return F.size(F.array_distinct(a)).cast("double")


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Both empty: 1; one empty: 0."""
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, F.lit(1.0)).otherwise(_common(a, b) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def dice(a: Column, b: Column) -> Column:
    """Both empty: 1; one empty: 0."""
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, F.lit(1.0)).otherwise(2.0 * _common(a, b) / F.greatest(_n(a) + _n(b), F.lit(1.0)))


def gate_dice(a: Column, b: Column) -> Column:
    """As dice, but 0 where the first set is empty."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(dice(a, b))


def overlaps(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def conflicts(a: Column, b: Column) -> Column:
    """Both have members and none in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def two_smallest(a: Column) -> Column:
    """The distinct members in code-point order, two at most."""
    return F.slice(F.array_sort(F.array_distinct(a)), 1, 2)


def digit_tokens(a: Column) -> Column:
    return F.filter(a, lambda t: t.rlike("^[0-9]+$"))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer length; 1 if both are empty."""
    x, y = (F.length(F.coalesce(c, F.lit(""))).cast("double") for c in (a, b))
    return F.when(F.greatest(x, y) == 0, F.lit(1.0)).otherwise(F.least(x, y) / F.greatest(x, y, F.lit(1.0)))


def weighted_dice(a: Column, b: Column, idf: Column, default: float) -> Column:
    """Dice of token weights from a map column; tokens that it lacks weigh ``default``; nothing in common: 0."""

    def total(x: Column) -> Column:
        return F.aggregate(F.array_sort(F.array_distinct(x)), F.lit(0.0), lambda s, t: s + F.coalesce(idf[t], F.lit(default)))

    both = F.array_intersect(a, b)
    return F.when(F.size(both) == 0, F.lit(0.0)).otherwise(2.0 * total(both) / (total(a) + total(b)))
