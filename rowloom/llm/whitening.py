"""Embedding whitening: leading principal components of the distinct vectors, and every vector's whitened coordinates.

Spark sums the covariance; the driver holds one width x width matrix and its eigenpairs, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import Scratch
from rowloom.llm.symmetric import leading_pairs

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
#: Entries beyond this have no exact step and count as not finite.
LARGEST = 2.0**52 / SCALE
LONG = 2**63
#: Eigenvalues below this share of the largest are rounding, not variance.
RANK = 1e-12
ROWS = 4096


def stepped(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, x)``: each entry c of a finite vector as the long floor(64 c) + 1000000.

    Rows with a null vector, an empty one, or a null or non-finite entry are left out, and so are those with entries whose
    step a double does not hold (beyond 7e13).
    """
    entries = F.col(vector).cast("array<double>")
    sound = F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))
    steps = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return vectors.where(F.coalesce(sound & (F.size(F.col(vector)) > 0), F.lit(False))).select(F.col(key), steps.alias("x"))


def usual_width(rows: DataFrame) -> int | None:
    """The most frequent length of ``x``, the longer of ties; None without rows."""
    top = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return top["width"] if top else None


@dataclass(frozen=True)
class Centre:
    """Exact mean of the fit list: n vectors with the per-dimension sums, which may be beyond a long."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as longs where they hold it and as Python integers otherwise."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * int(b) for s, b in zip(self.sums, base)]
        near = x - base
        if self.n * (int(np.max(np.abs(near), initial=0)) + 1) < LONG // 2:
            return near * self.n - np.array(rest, np.int64)
        return near.astype(object) * self.n - np.array(rest, object)

    def squares(self, deviations: np.ndarray) -> list[int | None]:
        """Exact sums of squares; null where a long does not hold one."""
        largest = int(np.max(np.abs(deviations), initial=0))
        if deviations.dtype != object and largest**2 * deviations.shape[1] < LONG:
            return (deviations * deviations).sum(axis=1).tolist()
        exact = deviations.astype(object)
        return [int(s) if s < LONG else None for s in (exact * exact).sum(axis=1)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n


def _matrices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            x = piece.column("x")
            yield piece, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def _summed_products(rows: DataFrame, width: int, prepare, k: int) -> np.ndarray:
    """Sums of the products of the k columns that ``prepare`` makes of x, over all rows: one partial matrix per task,
    added entry by entry on the executors."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, width):
            y = prepare(x)
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.divmod(np.arange(k * k, dtype=np.int64), k)
            upper = i <= j
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[upper]), pa.array(j[upper]), pa.array(total.ravel()[upper])], names=["i", "j", "v"]
            )

    out = np.zeros((k, k))
    for r in rows.select("x").mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def centre_of(fit: DataFrame, width: int) -> Centre:
    sums = fit.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    row = sums.first()
    return Centre(row["n"], tuple(int(v) for v in row[1:]) if row["n"] else ())


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: centre, eigenvalues (falling), unit eigenvectors as columns, total variance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    total: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Components of the distinct vectors ``x``. Directions without variance are no components, so there can be fewer.

    Two passes: the exact mean, then the covariance of the centred vectors. The matrix is reduced to three diagonals by
    reflections; its leading eigenvalues come from bisection by sign counts, their vectors from inverse iteration.
    """
    centre = centre_of(fit, width)
    covariance = _summed_products(fit, width, centre.centred, width) / centre.n
    values, vectors = leading_pairs(covariance, components)
    held = values > RANK * max(values[0], 0) if len(values) else np.zeros(0, bool)
    return Whitening(centre, values[held], vectors[:, held], float(np.trace(covariance)))


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """Largest entry, in size, of the fit list's whitened covariance minus the identity, summed over the rows again."""
    k = len(model.values)

    def with_one(x: np.ndarray) -> np.ndarray:
        return np.column_stack((model.project(x), np.ones(len(x))))

    products = _summed_products(fit, width, with_one, k + 1)
    mean = products[:k, k] / model.centre.n
    return float(np.max(np.abs(products[:k, :k] / model.centre.n - np.outer(mean, mean) - np.eye(k)), initial=0))


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per finite vector and component: ``key``, component, n, deviation, whitened, explained, identity_error.

    Vectors of another length than the usual one are left out, like those that are not finite; repeated keys and null
    keys are rows like any other, and equal vectors count once in the fit. No vectors, or no variance, give no rows.
    """
    rows = stepped(vectors, key, vector)
    schema = f"{rows.select(F.col(key)).schema.simpleString()[7:-1]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = usual_width(rows)
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == width)
    scratch = Scratch(vectors.sparkSession)
    fit = scratch.keep(rows.select("x").distinct(), "fit")
    model = fit_whitening(fit, width, components)
    error = identity_error(fit, width, model)
    scratch.drop("fit")
    k, explained = len(model.values), model.values / model.total if model.total else np.zeros(0)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for piece, x in _matrices(batches, width):
            count = len(x)
            if not k:
                continue
            deviations = pa.array(fitted.centre.squares(fitted.centre.deviations(x)), pa.int64())
            each = pa.array(np.repeat(np.arange(count), k))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, fitted.centre.n, np.int64)), deviations.take(each),
                    pa.array(fitted.project(x).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
