"""Column builders shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma of blue, green and red, rounded."""
    return F.round(b * 0.114 + g * 0.587 + r * 0.299).cast("int")


def lcg(k: Column, seed: int = 12345) -> Column:
    """A reproducible pseudo-random order of whole numbers, the same in any SQL engine."""
    whole = F.lit(2147483648).cast("long")
    return F.pmod(F.pmod(k.cast("long"), whole) * F.lit(1103515245).cast("long") + F.lit(seed).cast("long"), whole)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)


def mean(values: Column) -> Column:
    return ratio(total(values), F.size(values))


def spread(values: Column) -> Column:
    """Population standard deviation of an array of whole numbers, from exact integer sums."""
    n, s = F.size(values).cast("long"), total(values)
    return ratio(F.sqrt((n * squares(values) - s * s).cast("double")), n)


def at(values: Column, k: Column) -> Column:
    """Element k, counted from zero; null outside."""
    return F.get(values, k)


def positions(mask: Column) -> Column:
    """Indices of the non-zero elements."""
    return F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.get(mask, i) != 0)
