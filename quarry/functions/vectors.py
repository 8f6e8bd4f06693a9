"""Vector functions as columns: all inside the JVM, over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def quantize(a: Column) -> Column:
    """Components times 127, rounded half away from zero, as bytes."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x * 127.0))).cast("tinyint"))


def dequantize(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / 127.0)


def as_stored(a: Column) -> Column:
    """What a vector is after it was written and read again."""
    return dequantize(quantize(normalize(a)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(1.0))


def quantized_distance(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)
    return 1 - total / F.lit(127.0 * 127.0)


def min_max(x: Column, low: Column, high: Column, flat: float) -> Column:
    """x on 0..1 between low and high; flat where they are the same."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(flat))
