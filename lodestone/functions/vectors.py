"""Vector functions: exact cosine as an expression, and blocked products for search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def best_score(scores: Column) -> Column:
    """Best of a query's variants; never below -1, which also stands for no score."""
    return F.greatest(F.lit(-1.0), F.coalesce(F.max(scores), F.lit(-1.0)))


def check_dims(vector: Column, dims: int) -> Column:
    """The vector, or an error if its length isn't the index's."""
    return F.when(F.size(vector) == dims, vector).otherwise(
        F.raise_error(F.concat(F.lit("vector of length "), F.size(vector).cast("string"), F.lit(f" where the index has {dims}")))
    )
