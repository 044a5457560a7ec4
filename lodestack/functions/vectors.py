"""Vector expressions over array<float> or array<double> columns, computed in double."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in [0, 2]; 1 where a vector is zero."""
    return F.lit(1.0) - cosine_similarity(a, b)


def valid_vector(vector: Column, dims: int) -> Column:
    """Of exactly so many dimensions, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


@F.arrow_udf(StringType())
def _literals(vectors: pa.Array) -> pa.Array:
    return pa.array([None if v is None else "[" + ",".join([f"{x:.8f}" for x in v if x is not None]) + "]" for v in vectors.to_pylist()], pa.string())


def vector_literal(vector: Column) -> Column:
    """[x,y,...] with 8 decimals, rounded from the exact binary values, halves to even; null components are left out. Java's formatter rounds their shortest decimals."""
    return _literals(vector.cast("array<double>"))
