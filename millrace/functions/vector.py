"""Vectors: cosine similarity, text forms, dimension checks. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product in double precision; null where a vector is null, an error where their dimensions differ."""
    a, b = _column(a), _column(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    apart = F.concat(F.lit("vectors differ in dimension: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) != F.size(b), F.raise_error(apart).cast("double")).otherwise(total)


def squared(a: Column | str) -> Column:
    return F.aggregate(_column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column | str, b: Column | str, digits: int = 6, nan_policy: str = "drop", b_squared: Column | str | None = None) -> Column:
    """1 - cosine distance, in double precision, rounded; null where a vector is null.

    A zero vector has no direction: its score is null, or NaN (greater than all) under nan_policy "keep". Vectors of
    different dimensions are an error. b_squared: b's squared length, where it is known (a query's, once).
    """
    length = F.sqrt(squared(a) * (squared(b) if b_squared is None else _column(b_squared)))
    none = F.lit(float("nan")) if nan_policy == "keep" else F.lit(None).cast("double")
    null = _column(a).isNull() | _column(b).isNull()
    return F.when(null, F.lit(None).cast("double")).when(length == 0, none).otherwise(F.round(dot(a, b) / length, digits))


def parse(text: Column | str) -> Column:
    """A vector from its text, as in '[0.1,0.2]'."""
    return F.from_json(text, "array<float>")


def unparse(vector: Column | str) -> Column:
    """A vector's text; parse gives the same vector back."""
    return F.to_json(vector)
