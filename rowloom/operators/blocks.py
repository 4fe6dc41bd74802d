"""All-pairs work cut into equal chunk pairs, and small matrices summed up over all tasks.

A table is cut into chunks by the hash of its key, so chunks are even whatever the data looks like; two chunks meet once, in one
task that serves the rows of both, and only per-row partial results leave it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.vectors import matrix, vector_array

#: Bytes of vectors in a chunk. Each row is copied once per chunk of the other side, so large chunks mean few copies.
CHUNK_BYTES = 64 << 20
#: The same where all rows of one table meet, and how many pairs of chunks a core should get if that leaves chunks of so many rows.
PAIR_CHUNK_BYTES = 32 << 20
PAIRS_PER_CORE = 3
LEAST_CHUNK_ROWS = 4096
FEW_TASKS = 16


def chunk_count(rows: int, width: int, chunk_rows: int | None = None) -> int:
    return max(1, math.ceil(rows / (chunk_rows or max(1, CHUNK_BYTES // (8 * max(1, width))))))


def pair_chunks(rows: int, width: int, cores: int, chunk_rows: int | None = None) -> int:
    """Chunks of a table whose rows all meet: by bytes, and so that many rows make a few pairs of chunks for every core."""
    if chunk_rows:
        return chunk_count(rows, width, chunk_rows)
    spread = min(math.ceil((2 * PAIRS_PER_CORE * cores) ** 0.5), rows // LEAST_CHUNK_ROWS)
    return max(1, math.ceil(rows * 8 * max(1, width) / PAIR_CHUNK_BYTES), spread)


def over_chunk_pairs(
    table: DataFrame, key: str, chunks: int, work: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, within: tuple[str, ...] = ()
) -> DataFrame:
    """Run ``work(left chunk, right chunk, same)`` for every unordered pair of chunks of a table, also of one with itself; union of
    its results.

    ``within`` names columns; only rows that agree on them meet.
    """
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")
    left = table.withColumn("_l", chunk).withColumn("_r", F.explode(F.sequence(F.col("_l"), F.lit(chunks - 1))))
    right = table.withColumn("_r", chunk).withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_r"))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh columns, as both sides are one table
    by = (*within, "_l", "_r")
    if chunks > 1:  # a pair is much work for its bytes, so tasks are not merged by size
        tasks = chunks * (chunks + 1)
        left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        some = a if len(a) else b
        return work(a, b, some.column("_l")[0] == some.column("_r")[0])

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(met, schema)


def tree_reduced(
    table: DataFrame, columns: list[str], reduce_rows: Callable[..., np.ndarray], merge: Callable[[list[np.ndarray]], np.ndarray],
    partitions: int | None = None,
) -> np.ndarray:
    """A small matrix per task from ``reduce_rows`` of the array columns, merged in a tree on the executors; the matrices of
    up to ``FEW_TASKS`` tasks are merged on the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                found = reduce_rows(*[matrix(batch.column(c)) for c in columns])
                state = found if state is None else merge([state, found])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state.shape[0]], pa.int32()), vector_array(state.reshape(1, -1))], ["n", "state"])

    def joined(states: pa.Table) -> pa.Table:
        parts = [np.array(v).reshape(n, -1) for n, v in zip(states.column("n").to_pylist(), states.column("state").to_pylist())]
        state = merge(parts)
        out = pa.table({"n": pa.array([state.shape[0]], pa.int32()), "state": vector_array(state.reshape(1, -1))})
        return out.append_column("fan", states.column("fan").slice(0, 1)) if "fan" in states.column_names else out

    parts = table.select(*columns).mapInArrow(work, "n int, state array<double>")
    partitions = table.rdd.getNumPartitions() if partitions is None else partitions
    if partitions <= FEW_TASKS:
        found = parts.toArrow()
        return merge([matrix(found.column("state").slice(i, 1)).reshape(n, -1) for i, n in enumerate(found.column("n").to_pylist())])
    fan = math.ceil(partitions**0.5)
    parts = parts.withColumn("fan", (F.spark_partition_id() % fan).cast("int")).groupBy("fan").applyInArrow(joined, "n int, state array<double>, fan int").drop("fan")
    row = parts.groupBy().applyInArrow(joined, "n int, state array<double>").first()
    return np.array(row["state"]).reshape(row["n"], -1)


def _place(at: int) -> int:
    return at


def array_sum(arrays: RDD) -> np.ndarray:
    """Sum of arrays of one shape: per task, of more than ``FEW_TASKS`` tasks in two levels on the executors, and on the driver; always
    in the same order, so that equal arrays give equal sums."""

    def added(at: int, items: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        total = None
        for a in items:
            total = a.copy() if total is None else np.add(total, a, out=total)
        if total is not None:
            yield at, total

    parts, partitions = arrays.mapPartitionsWithIndex(added), arrays.getNumPartitions()
    if partitions > FEW_TASKS:
        fan = math.ceil(partitions**0.5)
        dealt = parts.map(lambda part: (part[0] % fan, part)).partitionBy(fan, _place)
        in_order = lambda items: (a for _, a in sorted((part for _, part in items), key=lambda part: part[0]))
        parts = dealt.mapPartitionsWithIndex(lambda at, items: added(at, in_order(items)))
    found = sorted(parts.collect(), key=lambda part: part[0])
    return np.sum([a for _, a in found], axis=0)
