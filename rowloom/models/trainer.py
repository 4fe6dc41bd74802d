"""Data-parallel training by local SGD: every task runs its own batches from shared weights, then weights are averaged.

Rows are spread over the tasks once, by a hash of their key, and every epoch sorts each task's rows anew by a
hash of (key, epoch): partitions are even and batches repeatable whatever the keys look like, and no epoch moves
rows between machines. One partition reproduces plain sequential training.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.vectors import matrix, vector_array
from rowloom.models import networks
from rowloom.models.networks import Design

# Fixed values of the optimizer.
BETAS, EPSILON, DECAY = (0.9, 0.999), 1e-8, 1e-5
CHUNK = 1 << 16
MAX_STATE_BYTES = 1 << 30
DRIVER_AVERAGE_BYTES = 64 << 20
BATCHES_PER_PARTITION = 32
STATE_SCHEMA = "chunk int, state array<double>, rows bigint, steps bigint, loss double, batches bigint"


@dataclass(frozen=True)
class Settings:
    epochs: int = 10
    batch_size: int = 1024
    learning_rate: float = 1e-3
    decay: float = DECAY
    patience: int = 5
    partitions: int | None = None
    seed: int = 0


@dataclass
class Trained:
    design: Design
    weights: np.ndarray
    track: list[tuple[int, float | None, float | None]] = field(default_factory=list)
    stopped: bool = False

    @property
    def last_losses(self) -> tuple[float | None, float | None]:
        return self.track[-1][1:] if self.track else (None, None)


def adam_step(w, m, v, step, gradient, rate, decay):
    """One update; the decay term is added to the gradient."""
    gradient = gradient + decay * w
    m = BETAS[0] * m + (1 - BETAS[0]) * gradient
    v = BETAS[1] * v + (1 - BETAS[1]) * gradient * gradient
    fitted = np.sqrt(v / (1 - BETAS[1] ** step)) + EPSILON
    return w - rate * (m / (1 - BETAS[0] ** step)) / fitted, m, v


def rebatch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, targets) in batches of exactly ``size`` rows, the last one shorter."""
    held_x, held_y, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held_x.append(matrix(batch.column("packed")))
        held_y.append(batch.column("target").to_numpy(zero_copy_only=False).astype(np.float64))
        held += batch.num_rows
        if held >= size:
            x, y = np.concatenate(held_x), np.concatenate(held_y)
            whole = held - held % size
            for at in range(0, whole, size):
                yield x[at : at + size], y[at : at + size]
            held_x, held_y, held = [x[whole:]], [y[whole:]], held - whole
    if held:
        yield np.concatenate(held_x), np.concatenate(held_y)


def loss_of(design: Design) -> tuple[Callable, int]:
    """Loss of a batch and the fewest rows it needs."""
    if design.outputs:
        return lambda p, x, y, rng: networks.prediction_loss(design, p, x, y), 1
    return lambda p, x, y, rng: networks.contrastive_loss(design, p, x, rng), 2


def run_batches(design: Design, state: np.ndarray, steps: int, batches, settings: Settings, rng) -> tuple:
    """Sequential updates over the batches of one task: (state, steps, rows, loss sum, batch count)."""
    objective, least = loss_of(design)
    w, m, v = state.reshape(3, -1)
    rows, losses, count = 0, 0.0, 0
    for x, y in batches:
        if len(x) < least:
            continue
        p = design.unpack(w)
        loss = objective(p, x, y, rng)
        loss.backward()
        steps += 1
        w, m, v = adam_step(w, m, v, steps, design.gradient(p), settings.learning_rate, settings.decay)
        rows, losses, count = rows + len(x), losses + float(loss.value), count + 1
    return np.concatenate([w, m, v]), steps, rows, losses, count


def _spread(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Even partitions by key hash, materialised."""
    return df.repartition(partitions, F.xxhash64(key)).persist(StorageLevel.MEMORY_AND_DISK)


def _shuffled(spread: DataFrame, key: str, *salt: int) -> DataFrame:
    """Each partition's rows in a fresh pseudo-random order."""
    place = F.xxhash64(F.col(key), *[F.lit(s) for s in salt])
    return spread.withColumn("_h", place).sortWithinPartitions("_h", key).select("packed", "target")


def _epoch(train: DataFrame, key: str, design: Design, state: np.ndarray, steps: int, epoch: int, partitions: int, settings: Settings):
    shared = train.sparkSession.sparkContext.broadcast(state)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([settings.seed, epoch, TaskContext.get().partitionId()])
        new, n, rows, losses, count = run_batches(
            design, shared.value, steps, rebatch(batches, settings.batch_size), settings, rng
        )
        if not count:
            return
        for i, at in enumerate(range(0, len(new), CHUNK)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), vector_array(new[None, at : at + CHUNK]), pa.array([rows], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([losses]), pa.array([count], pa.int64())],
                ["chunk", "state", "rows", "steps", "loss", "batches"],
            )

    parts = _shuffled(train, key, settings.seed, epoch).mapInArrow(work, STATE_SCHEMA)
    if state.nbytes * partitions > DRIVER_AVERAGE_BYTES:
        parts = parts.groupBy("chunk").applyInArrow(_average, STATE_SCHEMA)
    table = parts.toArrow()
    shared.unpersist()
    if not len(table):
        raise ValueError("no train batch had enough rows")
    merged = [_average(table.filter(pa.compute.equal(table.column("chunk"), c))) for c in range(-(-len(state) // CHUNK))]
    new = np.concatenate([matrix(t.column("state"))[0] for t in merged])
    first = merged[0].to_pylist()[0]
    return new, first["steps"], first["loss"] / first["batches"]


def _average(states: pa.Table) -> pa.Table:
    """Row-weighted mean of one chunk's states; losses and batches add up."""
    rows = states.column("rows").to_numpy().astype(np.float64)
    mean = (matrix(states.column("state")) * (rows / rows.sum())[:, None]).sum(axis=0)
    return pa.table(
        {
            "chunk": states.column("chunk").slice(0, 1),
            "state": vector_array(mean[None, :]),
            "rows": pa.array([int(rows.sum())], pa.int64()),
            "steps": pa.array([int(states.column("steps").to_numpy().max())], pa.int64()),
            "loss": pa.array([float(states.column("loss").to_numpy().sum())]),
            "batches": pa.array([int(states.column("batches").to_numpy().sum())], pa.int64()),
        }
    )


def evaluate(spread: DataFrame, design: Design, weights: np.ndarray, batch_size: int) -> float | None:
    """Mean of the batch losses without updates."""
    shared = spread.sparkSession.sparkContext.broadcast(weights)
    objective, least = loss_of(design)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = design.unpack(shared.value)
        losses = [float(objective(p, x, y, None).value) for x, y in rebatch(batches, batch_size) if len(x) >= least]
        if losses:
            yield pa.RecordBatch.from_arrays([pa.array([sum(losses)]), pa.array([len(losses)], pa.int64())], ["loss", "batches"])

    row = spread.mapInArrow(work, "loss double, batches bigint").agg(F.sum("loss").alias("l"), F.sum("batches").alias("b")).first()
    shared.unpersist()
    return row["l"] / row["b"] if row["b"] else None


def train(df: DataFrame, key: str, design: Design, settings: Settings, start: np.ndarray | None = None) -> Trained:
    """Train on ``df`` (key, split, packed, target) with early stopping on the validation loss.

    Weights, moments and one broadcast per epoch are all that passes the driver; their size is checked.
    """
    weights = design.initial(settings.seed) if start is None else start
    if weights.nbytes * 3 > MAX_STATE_BYTES:
        raise ValueError("the optimizer state exceeds its bound; lower the widths or the level counts")
    state = np.concatenate([weights, np.zeros(2 * len(weights))])
    rows = df.select(key, "split", "packed", "target")
    training = rows.filter(F.col("split") == "train")
    partitions = settings.partitions or _partitions(
        training.count(), settings.batch_size, df.sparkSession.sparkContext.defaultParallelism
    )
    training = _spread(training, key, partitions)
    held = _spread(rows.filter(F.col("split") == "validation"), key, max(1, partitions // 8))
    held_rows = _shuffled(held, key, settings.seed)
    result, steps, best, best_weights, waiting = Trained(design, weights), 0, None, None, 0
    for epoch in range(settings.epochs):
        state, steps, train_loss = _epoch(training, key, design, state, steps, epoch, partitions, settings)
        result.weights = state[: len(weights)]
        valid_loss = evaluate(held_rows, design, result.weights, settings.batch_size)
        result.track.append((epoch, train_loss, valid_loss))
        if settings.patience <= 0 or valid_loss is None:
            continue
        if best is None or valid_loss <= best:
            best, best_weights, waiting = valid_loss, result.weights, 0
        else:
            waiting += 1
            if waiting >= settings.patience:
                result.weights, result.stopped = best_weights, True
                break
    training.unpersist()
    held.unpersist()
    return result


def _partitions(rows: int, batch_size: int, cores: int) -> int:
    """One task per core, as long as every task has a good number of batches between two averages."""
    return max(1, min(cores, rows // (BATCHES_PER_PARTITION * batch_size)))
