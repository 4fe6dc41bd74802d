"""k-means for several k and starts at once, with distance bounds kept beside the rows.

Rows are packed into blocks that stay where they are. A block carries, for every run, the cluster of each row, an upper
bound of the distance to its centre and a lower bound of that to any other. Centres that move shift the bounds; only
rows whose bounds meet are measured again. What leaves a task are sums per cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.vectors import matrix, vector_array
from rowloom.operators.blocks import array_sum, tree_reduced
from rowloom.session import ensure_checkpoint_dir

BLOCK_BYTES = 4 << 20
#: Points drawn in each seeding round per wanted centre, and rounds.
OVERSAMPLE = 2
SEED_ROUNDS = 4
#: Lineage is cut after so many iterations.
CHECKPOINT_EVERY = 10
SLACK = 1e-9


@dataclass
class Clustering:
    """One run: its centres, the sum of squared distances to them, and the iterations that it took."""

    k: int
    start: int
    centres: np.ndarray
    inertia: float = np.inf
    iterations: int = 0


@dataclass
class Fit:
    """The best run of every k, all runs, and distances measured of those that plain iterations would measure."""

    best: dict[int, Clustering]
    runs: list[Clustering]
    measured: int
    plain: int


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """From direct differences, a centre at a time."""
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1) if len(x) else np.zeros((0, len(centres)))


def packed(df: DataFrame, vector: str) -> DataFrame:
    """Blocks ``(id, n, x)`` of the rows in hash order, so that the same rows give the same blocks."""
    width = (df.select(F.size(vector)).first() or [0])[0]
    rows = max(1, min(4096, BLOCK_BYTES // (8 * max(1, width))))
    parts = max(1, -(-df.count() // (4 * rows)))
    ordered = df.select(F.col(vector).alias("v"), F.xxhash64(vector).alias("h")).repartition(parts, "h").sortWithinPartitions("h", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, n = [], 0, 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()])], ["id", "n", "x"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                if n and n + piece.num_rows > rows:
                    yield out()
                    held, n = [], 0
                if not n:
                    first = piece.column("h")[0].as_py()
                held.append(matrix(piece.column("v")))
                n += piece.num_rows
        if n:
            yield out()

    return ordered.mapInArrow(pack, "id long, n int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            yield row, np.frombuffer(row["x"]).reshape(row["n"], -1)


def _totals(rows: DataFrame, partitions: int | None = None) -> np.ndarray:
    """Element-wise sums of the arrays in column ``w``."""
    return tree_reduced(rows, ["w"], lambda w: w.sum(axis=0)[None, :], lambda parts: np.sum(parts, axis=0), partitions)[0]


def seeded(blocks: DataFrame, ks: tuple[int, ...], starts: int, seed: int) -> list[Clustering]:
    """Centres to begin with: for each start some rounds of points drawn in proportion to their squared distance from
    those drawn so far, a mergeable draw without replacement; then, weighted by the rows nearest to each, the centres of
    every k are drawn from the candidates on the driver."""
    draw = OVERSAMPLE * max(ks)
    chosen: list[np.ndarray | None] = [None] * starts
    for turn in range(SEED_ROUNDS + 1):
        wanted = draw if turn else 1

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops: list[np.ndarray | None] = [None] * starts
            for row, x in _blocks(batches):
                for s in range(starts):
                    weight = np.ones(len(x)) if chosen[s] is None else distances(x, chosen[s]).min(axis=1) ** 2
                    noise = np.random.default_rng([seed, s, turn, row["id"] & 0xFFFFFFFFFFFF]).random(len(x))
                    with np.errstate(divide="ignore"):
                        rank = np.where(weight > 0, np.log(noise) / weight, -np.inf)
                    found = np.column_stack((np.full(len(x), float(s)), rank, x))[np.isfinite(rank)]
                    both = found if tops[s] is None else np.concatenate((tops[s], found))
                    tops[s] = both[np.argsort(-both[:, 1], kind="stable")[:wanted]]
            for top in tops:
                if top is not None and len(top):
                    yield pa.RecordBatch.from_arrays([pa.array(top[:, 0].astype(np.int32)), pa.array(top[:, 1]), vector_array(top[:, 2:])], ["s", "rank", "v"])

        drawn = blocks.mapInArrow(sample, "s int, rank double, v array<double>")
        kept = drawn.groupBy("s").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "v")), False), 1, wanted).alias("top"))
        for r in kept.collect():  # at most starts * draw points
            new = np.array([p["v"] for p in r["top"]])
            chosen[r["s"]] = new if chosen[r["s"]] is None else np.unique(np.concatenate((chosen[r["s"]], new)), axis=0)
    sizes = [len(c) for c in chosen]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(sum(sizes))
        for _, x in _blocks(batches):
            counts += np.concatenate([np.bincount(distances(x, c).argmin(axis=1), minlength=len(c)) for c in chosen])
        yield pa.RecordBatch.from_arrays([vector_array(counts[None, :])], ["w"])

    counts = _totals(blocks.mapInArrow(weigh, "w array<double>"))
    weights = np.split(counts, np.cumsum(sizes)[:-1])
    runs = []
    for k in ks:
        for s in range(starts):
            rng, points, w = np.random.default_rng([seed, s, k]), chosen[s], weights[s]
            picked = [int(rng.choice(len(points), p=w / w.sum()))]
            while len(picked) < min(k, len(points)):
                far = w * distances(points, points[picked]).min(axis=1) ** 2
                if not far.any():
                    break
                picked.append(int(rng.choice(len(points), p=far / far.sum())))
            runs.append(Clustering(k, s, points[picked].copy()))
    return runs


def _measured(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centre, distance to it, distance to the next) of every row; ties go to the first centre."""
    d = distances(x, centres)
    a = d.argmin(axis=1)
    u = d[np.arange(len(x)), a]
    d[np.arange(len(x)), a] = np.inf
    return a, u, d.min(axis=1, initial=np.inf)


def _sums(x: np.ndarray, a: np.ndarray, k: int) -> np.ndarray:
    """Sums and counts per cluster, as rows of k."""
    order = np.argsort(a, kind="stable")
    found, starts = np.unique(a[order], return_index=True)
    out = np.zeros((k, x.shape[1] + 1))
    if len(found):
        out[found, :-1] = np.add.reduceat(x[order], starts, axis=0)
        out[found, -1] = np.diff(np.append(starts, len(x)))
    return out


def fit(df: DataFrame, vector: str, ks: tuple[int, ...], starts: int = 3, seed: int = 0, max_iter: int = 300) -> Fit:
    """k-means of all rows for every k from several starts, until no row changes its cluster; the lowest inertia wins.

    ``vector`` is an array of doubles. A cluster that loses all rows keeps its centre. There are fewer than k clusters where there are fewer
    distinct rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    blocks = packed(df, vector).persist(StorageLevel.MEMORY_AND_DISK)
    total, parts = blocks.agg(F.sum("n")).first()[0], blocks.rdd.getNumPartitions()
    if not total:
        raise ValueError("there are no rows to cluster")
    runs = seeded(blocks, ks, starts, seed)
    at = np.cumsum([0, *[len(r.centres) for r in runs]])
    shifts: list[np.ndarray] | None = None
    # the state is an RDD: a DataFrame's plan would hold those of all iterations before, and planning it takes twice as long each time
    state = blocks.rdd.map(lambda row: {"x": np.frombuffer(row["x"]).reshape(row["n"], -1)})
    measured, plain = 0, 0
    live = np.ones(len(runs), bool)

    for turn in range(max_iter):
        shared = spark.sparkContext.broadcast(([r.centres for r in runs], shifts, live.copy()))

        def step(items: Iterator[dict]) -> Iterator[dict]:
            centres, moved, active = shared.value
            for row in items:
                x, count, fresh = row["x"], 0, moved is None
                n, width = x.shape
                a = np.zeros((len(centres), n), np.int16) if fresh else row["a"].copy()
                u, l = (np.zeros((len(centres), n)) if fresh else row[c].copy() for c in ("u", "l"))
                sums = np.zeros((at[-1], width + 1)) if fresh else row["sums"].copy()
                for r in np.flatnonzero(active):
                    c, mine = centres[r], slice(at[r], at[r + 1])
                    if fresh:
                        a[r], u[r], l[r] = _measured(x, c)
                        count += n * len(c)
                        sums[mine] = _sums(x, a[r], len(c))
                        continue
                    top = np.sort(moved[r])[::-1]
                    others = np.where(np.arange(len(c)) == moved[r].argmax(), top[1] if len(c) > 1 else 0.0, top[0])
                    u[r] += moved[r][a[r]]
                    l[r] -= others[a[r]]
                    apart = distances(c, c)
                    np.fill_diagonal(apart, np.inf)
                    bound = np.maximum(l[r], apart.min(axis=1)[a[r]] / 2) * (1 - SLACK)
                    some = np.flatnonzero(u[r] >= bound)
                    if not len(some):
                        continue
                    u[r][some] = np.sqrt(((x[some] - c[a[r][some]]) ** 2).sum(axis=1))
                    count += len(some)
                    some = some[u[r][some] >= bound[some]]
                    if len(some):
                        was = a[r][some].copy()
                        a[r][some], u[r][some], l[r][some] = _measured(x[some], c)
                        count += len(some) * len(c)
                        if (was != a[r][some]).any():
                            sums[mine] = _sums(x, a[r], len(c))
                yield {"x": x, "a": a, "u": u, "l": l, "sums": sums, "measured": count}

        after = state.mapPartitions(step).persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            after.checkpoint()
        found = array_sum(after.map(lambda row: np.append(row["sums"], row["measured"])))
        sums, measured = found[:-1].reshape(at[-1], -1), measured + int(found[-1])
        plain += int(total) * int(np.diff(at)[live].sum())
        state.unpersist()
        state, shifts = after, []
        for r, run in enumerate(runs):
            mine = sums[at[r] : at[r + 1]]
            held = mine[:, -1] > 0
            means = np.where(held[:, None], mine[:, :-1] / np.maximum(mine[:, -1:], 1), run.centres)
            shifts.append(np.sqrt(((means - run.centres) ** 2).sum(axis=1)))
            if live[r]:
                run.centres, run.iterations = means, run.iterations + 1
                live[r] = shifts[r].any()
        if not live.any():
            break
    state.unpersist()

    def inertia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([vector_array(np.array([[(_measured(x, r.centres)[1] ** 2).sum() for r in runs]]))], ["w"])

    found = _totals(blocks.mapInArrow(inertia, "w array<double>"), parts)
    blocks.unpersist()
    for run, value in zip(runs, found):
        run.inertia = float(value)
    best = {k: min((r for r in runs if r.k == k), key=lambda r: (r.inertia, r.start)) for k in ks}
    return Fit(best, runs, int(measured), plain)
