"""Vector functions: squared L2, similarity, norm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from lumenseek.session import ship_package


def squared_l2(vector: Column, query: list[float]) -> Column:
    """Squared L2 distance to a fixed query vector, summed left to right in double.

    The query travels inside the function, so scoring a table needs no join.
    Vectors cross to NumPy as Arrow buffers, without a Python object per row;
    measured on 300 000 x 64 this takes half the time of higher-order
    functions and of a fully unrolled expression.
    """
    ship_package(SparkSession.active())
    q = np.asarray([float(x) for x in query], dtype=np.float64)

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        return pa.array(array_distances(vectors, q), pa.float64(), from_pandas=True)

    return distance(vector)


def array_distances(vectors: pa.Array, query: np.ndarray) -> np.ndarray:
    """Distances of an Arrow list column to a query; NaN for a missing vector."""
    out = np.full(len(vectors), np.nan)
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    filled = np.flatnonzero(sizes)
    if len(filled):
        if (sizes[filled] != len(query)).any():
            raise ValueError(f"a vector differs from the query's {len(query)} dimensions")
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[filled] = ordered_squared_l2(values.reshape(len(filled), len(query)), query)
    return out


def ordered_squared_l2(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row-wise squared distance, dimension by dimension so that rounding is fixed."""
    total = np.zeros(len(matrix))
    for column, q in zip(np.ascontiguousarray(matrix.T), query):
        d = column - q
        total += d * d
    return total


def similarity(d2: Column) -> Column:
    """Clamped 1 - d2/2; a missing distance counts as zero, hence similarity 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(d2, F.lit(0.0)) / 2))


def l2_norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector in double; a zero vector stays as it is."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = l2_norm(vector)
    return F.when(norm == 0, doubles).otherwise(F.transform(doubles, lambda x: x / norm))


def has_vector(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0)


def checked_dimension(vector: Column, dimension: int) -> Column:
    """The vector itself; the job fails on a vector of any other length."""
    wrong = F.concat(F.lit("vector dimension "), F.size(vector).cast("string"),
                     F.lit(f" differs from the index dimension {dimension}"))
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(wrong))


def wrong_dimension(vector: Column, dimension: int) -> Column:
    return F.size(vector) != dimension
