"""Vector expressions over ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def is_valid(vector: Column) -> Column:
    """Non-empty, no NULL, all finite. A NULL vector is not valid."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Sum of products from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0.0 if either vector is zero, NULL for different lengths."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    value = F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))
    return F.when(F.size(a) == F.size(b), value)


def hash_vector(text: Column) -> Column:
    """Deterministic stand-in for an embedding: 32 centred bytes of the SHA-256 of the text."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(digest, i * 2 + 1, 2), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (byte(i) - 127.5) / 127.5)
