"""Vector expressions on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def doubles(vector: Column | str) -> Column:
    return as_column(vector).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(NORM_FLOOR))


def unit(a: Column | str) -> Column:
    length = norm(a)
    return F.transform(as_column(a), lambda x: x / length)


def cosine(a: Column | str, b: Column | str, temperature: float = 1.0) -> Column:
    return dot(a, b) / (norm(a) * norm(b) * F.lit(temperature))


def mean_squared_difference(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(as_column(a), as_column(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x) / F.size(as_column(a))


def mean_vector(*vectors: Column | str) -> Column:
    """Element-wise mean of vectors of one row."""
    total = as_column(vectors[0])
    for vector in vectors[1:]:
        total = F.zip_with(total, as_column(vector), lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(vectors))


def flatten_tensor(tensor: Column | str, depth: int) -> Column:
    """Flatten ``depth`` nested array levels to one vector."""
    column = as_column(tensor)
    for _ in range(depth - 1):
        column = F.flatten(column)
    return column


def part(vector: Column | str, index: int, width: int) -> Column:
    """The ``index``-th block of ``width`` elements."""
    return F.slice(as_column(vector), index * width + 1, width)


def round_vector(vector: Column | str, digits: int = 6) -> Column:
    return F.transform(as_column(vector), lambda x: F.round(x, digits))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Arrow list column of equal-length vectors to a two-dimensional array, without Python rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n == 0:
        return np.zeros((0, 0))
    if vectors.null_count or flat.size % n or len(vectors[0]) * n != flat.size:
        raise ValueError("vectors must be present and of one length")
    return flat.reshape(n, -1)


def vector_array(values: np.ndarray) -> pa.Array:
    """Two-dimensional array to an Arrow list column."""
    n, width = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)) if width else pa.array(np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values, dtype=np.float64).reshape(-1)))


def squared_distances(a: np.ndarray, b: np.ndarray, categories: int = 0) -> np.ndarray:
    """Squared Euclidean distances between the rows of two matrices.

    The first ``categories`` columns hold category codes and count as one-hot vectors would: two different
    codes are 2 apart, and a code below zero stands for an all-zero vector, 1 from any code. The product form is taken
    about the mean of ``b``, which changes no distance; ``distance_error`` bounds its error.
    """
    centre = b[:, categories:].mean(axis=0) if len(b) else 0.0
    x, y = a[:, categories:] - centre, b[:, categories:] - centre
    d2 = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    np.maximum(d2, 0.0, out=d2)
    for c in range(categories):
        left, right = a[:, c], b[:, c]
        d2 += (left[:, None] != right[None, :]) * ((left >= 0)[:, None].astype(np.float64) + (right >= 0)[None, :])
    return d2


def distance_error(a: np.ndarray, b: np.ndarray, categories: int = 0) -> np.ndarray:
    """For each row of ``a`` a bound of the error of its ``squared_distances``."""
    centre = b[:, categories:].mean(axis=0) if len(b) else 0.0
    x, y = a[:, categories:] - centre, b[:, categories:] - centre
    largest = (y * y).sum(axis=1).max(initial=0.0)
    return 4 * (a.shape[1] + 8) * np.finfo(float).eps * ((x * x).sum(axis=1) + largest + 4.0)


def paired_squares(a: np.ndarray, b: np.ndarray, categories: int = 0) -> np.ndarray:
    """Squared distance of each row of ``a`` to the same row of ``b``, from direct differences."""
    gap = a[:, categories:] - b[:, categories:]
    left, right = a[:, :categories], b[:, :categories]
    apart = (left != right) * ((left >= 0).astype(np.float64) + (right >= 0))
    return (gap * gap).sum(axis=1) + apart.sum(axis=1)


def paired_distances(a: np.ndarray, b: np.ndarray, categories: int = 0) -> np.ndarray:
    """Euclidean distance of each row of ``a`` to the same row of ``b``, from direct differences."""
    return np.sqrt(paired_squares(a, b, categories))
