"""Score arithmetic shared by the vector operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the grade bands.
GRADE_BANDS = (("very high", 0.8), ("high", 0.6), ("medium", 0.4))
LOWEST_GRADE = "low"


def rescale(score: Column) -> Column:
    """A raw score in [-1, 1] to [0, 1], clamped at both ends."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + F.lit(1.0)) / F.lit(2.0)))


def similarity_from_distance(distance: Column) -> Column:
    """A distance in [0, 2] to a similarity in [0, 1]."""
    return F.lit(1.0) - distance / F.lit(2.0)


def grade(similarity: Column) -> Column:
    (label, bound), *rest = GRADE_BANDS
    out = F.when(similarity >= bound, label)
    for label, bound in rest:
        out = out.when(similarity >= bound, label)
    return out.otherwise(LOWEST_GRADE)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long numeric arrays, 0 when one has no length; JVM-side."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
