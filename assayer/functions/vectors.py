"""Column expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    v = v.cast("array<double>")
    # The norm is the variable of an outer lambda, and so is worked out once a vector and not once an element.
    norm = F.array(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-10)))
    return F.transform(norm, lambda n: F.transform(v, lambda x: x / n))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
