"""Vector kernels as column expressions; everything is computed in double precision on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def norm2(a: Column) -> Column:
    """Squared length."""
    return F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda t, v: t + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; two zero vectors are alike (1), one zero vector is unrelated (0)."""
    na, nb = norm2(a), norm2(b)
    raw = dot(a, b) / F.sqrt(F.nullif(na * nb, F.lit(0.0)))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """One less cosine, in [0, 2]."""
    return 1.0 - cosine(a, b)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, v: t + v))


def of_dimension(a: Column, n: int) -> Column:
    """The array, or an error if it does not hold ``n`` numbers."""
    return F.when(F.size(a) == n, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} numbers, got "), F.size(a).cast("string"))))


def fold48(data: Column, width: int = 48) -> Column:
    """Fold bytes into ``width`` wrapping signed sums: place i adds to bucket i mod width."""
    digits = F.hex(data)
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    size = F.octet_length(data)

    def bucket(b: Column) -> Column:
        places = F.when(b < size, F.sequence(b, size - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
        total = F.aggregate(places, F.lit(0).cast("long"), lambda t, i: t + byte(i))
        return F.pmod(total + 128, F.lit(256)) - 128

    return F.transform(F.array(*[F.lit(i) for i in range(width)]), bucket)


def nibbles(tile: Column) -> Column:
    """Signed four-bit values of a byte string, low nibble first."""
    digits = F.hex(tile)
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(tile)), lambda i: F.array(F.substring(digits, i * 2, F.lit(1)), F.substring(digits, i * 2 - 1, F.lit(1))))
    return F.transform(F.flatten(pairs), lambda d: F.pmod(F.conv(d, 16, 10).cast("int") + 8, F.lit(16)) - 8)


def nibble_product(tile: Column, weight: Callable[[Column], Column], scale: float) -> Column:
    """scale * sum of weight(i) * q_i over the signed nibbles q of one row of a matrix."""
    terms = F.transform(nibbles(tile), lambda q, i: q * weight(i))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda t, x: t + x) * F.lit(scale)
