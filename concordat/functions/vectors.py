"""Vector functions on arrays of floats, summed as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine within [-1, 1]; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Distance; infinite where a vector is null."""
    squares = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.coalesce(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), F.lit(float("inf")))


def unit(a: Column | str) -> Column:
    """The vector at length 1; one without length stays as it is."""
    size = norm(a)
    return F.when(size == 0, F.transform(_col(a), lambda x: x.cast("double"))).otherwise(F.transform(_col(a), lambda x: x.cast("double") / size))
