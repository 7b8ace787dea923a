"""Vector and bit-string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def half(h: Column, which: int) -> Column:
    """One 32-bit half of 16 hex digits as a number."""
    return F.conv(F.substring(h, 1 + 8 * which, 8), 16, 10).cast("long")


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two strings of 16 hex digits; null where lengths differ."""
    bits = sum(F.bit_count(half(a, i).bitwiseXOR(half(b, i))) for i in (0, 1))
    return F.when(F.length(a) == F.length(b), bits)
