"""Bag of words over train texts, and principal components of its count matrix."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import tokens
from rowloom.functions.vectors import doubles, matrix, vector_array
from rowloom.operators.sampling import cached
from rowloom.operators.termshards import document_groups, group_count, leading_loadings, projected
from rowloom.session import ensure_checkpoint_dir

COMPONENTS = 10  # fixed value: components kept for text and dense variables
OVERSAMPLE = 8
#: Passes go on until C l differs from its multiple of l by this part of the greatest eigenvalue, for every component.
TOLERANCE = 1e-4
#: Blocks that a Krylov basis holds before it is restarted from its best vectors.
MAX_BLOCKS = 6
#: A pass that lowers no residual in so many restarts means that the tolerance is below rounding.
MAX_RESTARTS = 200
CHUNK_TERMS = 8192
#: Bytes of one block of a basis of terms in a task.
MAX_BASIS_BYTES = 1 << 25


def vocabulary(train: DataFrame, text: str) -> DataFrame:
    """Every token of the train texts with its count: (token, n)."""
    return train.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class TextComponents:
    """Fitted text projection: ``table`` holds the terms and loadings of every shard; ``offset`` is the projected mean."""

    table: RDD | None
    offset: list[float]
    width: int
    n_terms: int
    shards: int = 1
    passes: int = 0

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        key: str,
        text: str,
        width: int = COMPONENTS,
        seed: int = 0,
        tolerance: float = TOLERANCE,
        max_basis_bytes: int = MAX_BASIS_BYTES,
    ) -> "TextComponents":
        """Block Krylov iteration on the centred count matrix of the train rows, over the whole vocabulary.

        Counts and basis (terms by columns) are cut into shards of terms and stay on the executors; a task holds no more than
        ``max_basis_bytes`` of a block. Only matrices as wide as the basis come to the driver.
        """
        train = df.filter(F.col("split") == "train")
        size = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("bytes")).first()
        ensure_checkpoint_dir(df.sparkSession)
        cores = df.sparkSession.sparkContext.defaultParallelism
        groups = cached(document_groups(train, key, text, group_count(size["bytes"] or 0, cores)))
        table, offset, shards, n_terms, passes = leading_loadings(
            groups, lambda k: Krylov(k, width, tolerance), size["n"], width + OVERSAMPLE, width, seed, max_basis_bytes
        )
        groups.unpersist()
        return cls(table, offset, len(offset), n_terms, shards, passes)

    def transform(self, df: DataFrame, key: str, text: str, output: str) -> DataFrame:
        """Add the projection of every row's text; words outside the vocabulary count nothing."""
        if self.table is None:
            return df.withColumn(output, F.array().cast("array<double>"))
        sums = projected(df, key, text, self.table, self.shards, self.width, "_sums")
        shifted = F.array(*[F.coalesce(F.col("_sums")[i], F.lit(0.0)) - F.lit(o) for i, o in enumerate(self.offset)])
        return df.join(sums, key, "left").withColumn(output, shifted).drop("_sums")


class Krylov:
    """What a block Krylov basis knows of a symmetric operator C: its small matrix S'CS, and when the leading pairs are settled.

    The basis S is kept by the caller, as an array or as a table. Each step multiplies its last block and reports the
    products with all of S and the triangle R of what is left; a restart keeps the best vectors, those that are settled in front,
    where they are no longer multiplied but everything stays orthogonal to them.
    """

    def __init__(self, block: int, width: int, tolerance: float):
        self.block, self.width, self.tolerance = block, width, tolerance
        self.last = block
        self.small = np.zeros((block, block))
        self.passes = self.restarts = 0

    def step(self, products: np.ndarray, rest: np.ndarray) -> bool:
        self.passes += 1
        n, m = self.small.shape[0], self.last
        self.small[:, n - m :] = products
        self.small[n - m :, :] = products.T
        values, turn = np.linalg.eigh((self.small + self.small.T) / 2)
        self.values, self.turn = values[::-1], turn[:, ::-1]
        self.residuals = np.linalg.norm(rest @ self.turn[n - m :], axis=0)
        self.scale = max(abs(self.values[0]), 1e-300) if n else 1.0
        return bool(self.residuals[: self.width].max(initial=0.0) <= self.tolerance * self.scale)

    def grown(self, columns: int) -> None:
        n = self.small.shape[0]
        self.small = np.pad(self.small, (0, columns))
        assert self.small.shape[0] == n + columns
        self.last = columns

    def full(self) -> bool:
        return self.small.shape[0] >= MAX_BLOCKS * self.block

    def restarted(self) -> np.ndarray:
        """The combinations of S's columns that the new basis consists of."""
        self.restarts += 1
        if self.restarts > MAX_RESTARTS:
            raise RuntimeError(f"components did not settle in {self.passes} passes")
        settled = self.residuals[: self.width] <= 0.1 * self.tolerance * self.scale
        locked = int(np.argmin(settled)) if not settled.all() else len(settled)
        self.last = min(self.block, len(self.values) - locked)
        self.small = np.diag(np.concatenate((self.values[:locked], np.zeros(self.last))))
        return self.turn[:, : locked + self.last]


def _signs(loadings: np.ndarray) -> np.ndarray:
    """Signs that make the largest entry of every column positive."""
    return np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


def leading_vectors(
    multiply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, width: int, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray, int]:
    """(unit vectors as columns, their eigenvalues, passes) of the operator ``multiply``, from a Krylov basis held as an array."""
    basis = np.linalg.qr(start)[0]
    state = Krylov(basis.shape[1], width, tolerance)
    while True:
        left = multiply(basis[:, basis.shape[1] - state.last :])
        products = np.zeros((basis.shape[1], left.shape[1]))
        for _ in range(2):  # twice, so that rounding does not bring earlier directions back
            again = basis.T @ left
            left = left - basis @ again
            products += again
        block, rest = np.linalg.qr(left)
        if state.step(products, rest):
            break
        if state.full():
            basis = np.linalg.qr(basis @ state.restarted())[0]
            continue
        kept = np.abs(np.diagonal(rest)) > 1e-10 * state.scale
        block = block[:, kept] - basis @ (basis.T @ block[:, kept])
        basis = np.concatenate((basis, block), axis=1)
        state.grown(block.shape[1])
    vectors = basis @ state.turn[:, :width]
    return vectors * _signs(vectors), state.values[:width], state.passes


_PARTIAL = "chunk int, rows array<int>, sums array<double>"


def _partial(chunk: int, rows: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), pa.array(a.reshape(-1))) for a in (rows.astype(np.int32), sums)]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *lists], ["chunk", "rows", "sums"])


def _added(df: DataFrame, work: Callable, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The partial sums that ``work`` yields per task, added per chunk on the executors: (rows, sums) of every chunk.

    In two levels, so that no task adds the sums of all tasks.
    """

    def add(states: pa.Table) -> pa.Table:
        rows = states.column("rows").combine_chunks().flatten().to_numpy()
        found, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(found), width))
        sums = states.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, width)
        at = 0
        for n in np.diff(np.asarray(states.column("rows").combine_chunks().offsets)):
            total[place[at : at + n]] += sums[at : at + n]  # rows of one partial sum are distinct
            at += n
        out = pa.Table.from_batches([_partial(states.column("chunk")[0].as_py(), found, total)])
        return out.append_column("fan", states.column("fan").slice(0, 1)) if "fan" in states.column_names else out

    parts = df.mapInArrow(work, _PARTIAL)
    fan = math.ceil(df.rdd.getNumPartitions() ** 0.5)
    if fan > 2:
        parts = parts.withColumn("fan", (F.spark_partition_id() % fan).cast("int"))
        parts = parts.groupBy("chunk", "fan").applyInArrow(add, f"{_PARTIAL}, fan int").drop("fan")
    found = parts.groupBy("chunk").applyInArrow(add, _PARTIAL).toArrow()
    for i in range(len(found)):
        rows, sums = (found.column(c).slice(i, 1).combine_chunks().flatten().to_numpy() for c in ("rows", "sums"))
        yield rows, sums.reshape(-1, width)


def _dense_product(rows: DataFrame, block: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Xc' Xc block for the centred vectors in column ``v``: one pass, without the matrix Xc' Xc."""
    shared = rows.sparkSession.sparkContext.broadcast((block, mean))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, centre = shared.value
        sums, seen = np.zeros_like(side), False
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v")) - centre
                sums += x.T @ (x @ side)
                seen = True
        for i, at in enumerate(range(0, len(sums) if seen else 0, CHUNK_TERMS)):
            some = np.arange(at, min(at + CHUNK_TERMS, len(sums)))
            yield _partial(i, some, sums[some])

    total = np.zeros_like(block)
    for places, sums in _added(rows, work, block.shape[1]):
        total[places] = sums
    shared.unpersist()
    return total


def _mean_of(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and mean of the vectors in column ``v``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                n, sums = n + batch.num_rows, sums + matrix(batch.column("v")).sum(axis=0)
        if n:
            yield _partial(0, np.arange(width + 1), np.append(sums, n)[:, None])

    total = np.zeros(width + 1)
    for places, sums in _added(rows, work, 1):
        total[places] = sums[:, 0]
    return int(total[-1]), total[:-1] / max(total[-1], 1.0)


def dense_components(df: DataFrame, vector: str, output: str, width: int = COMPONENTS, tolerance: float = 1e-10) -> DataFrame:
    """Mean-centred principal components of a dense vector column, fitted on train; signs by the largest loading.

    The same Krylov iteration as for texts: a pass returns the product with one block, never a width by width matrix.
    """
    rows = cached(df.filter(F.col("split") == "train").select(doubles(vector).alias("v")))
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        raise ValueError("there are no train rows to fit components on")
    n, mean = _mean_of(rows, first["n"])
    k = min(width + OVERSAMPLE, first["n"], n)
    start = np.random.default_rng(0).standard_normal((first["n"], k))
    loadings, _, _ = leading_vectors(lambda block: _dense_product(rows, block, mean), start, min(width, k), tolerance)
    rows.unpersist()
    shared = df.sparkSession.sparkContext.broadcast((loadings, mean))

    @F.arrow_udf("array<double>")
    def project(vectors: pa.Array) -> pa.Array:
        axes, centre = shared.value
        return vector_array((matrix(vectors) - centre) @ axes if len(vectors) else np.zeros((0, axes.shape[1])))

    return df.withColumn(output, project(doubles(vector)))
