"""Boosted trees over histograms: squared error, or softmax with one tree per class and round.

Numbers are cut at quantiles of a mergeable sketch, categories by level. Rows are packed into blocks that carry their
margins. For every level of a round's trees each task sums gradients per (class, node, variable, bin); the sums are added
up, the driver picks the splits, and only the smaller child of a split node is summed again: its sibling is the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.blocks import array_sum
from rowloom.session import ensure_checkpoint_dir

# Settings of the boosted trees.
ROUNDS, DEPTH, STEP = 100, 6, 0.3
L2, MIN_WEIGHT = 1.0, 1.0
BINS = 256
ACCURACY = 10_000
BLOCK_ROWS = 16_384
#: A partition holds at least so many rows, if there are as many.
PARTITION_ROWS = 32_768
CHECKPOINT_EVERY = 10
#: Sums that a task may hold, in bytes.
MAX_SUMS_BYTES = 256 << 20
STATS = 3  # gradient, curvature, rows


@dataclass
class Tree:
    """Splits by node, as (variable, bin), children at 2i+1 and 2i+2; a node without one is a leaf."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)


@dataclass
class Boosted:
    """A fitted model: category variables (with their sizes) before numbers (with their cuts), and trees per round and class."""

    sizes: list[int]
    cuts: list[np.ndarray]
    classes: int
    base: float
    rounds: list[list[Tree]]

    @property
    def widths(self) -> list[int]:
        return [*[n + 1 for n in self.sizes], *[len(c) + 1 for c in self.cuts]]

    def binned(self, codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Bins of every row and variable; a code outside the fitted levels is in the last bin, which no split names."""
        out = np.empty((codes.shape[0] if self.sizes else numbers.shape[0], len(self.widths)), np.int32)
        for i, n in enumerate(self.sizes):
            out[:, i] = np.where((codes[:, i] >= 0) & (codes[:, i] < n), codes[:, i], n)
        for i, cuts in enumerate(self.cuts):
            out[:, len(self.sizes) + i] = np.searchsorted(cuts, numbers[:, i], side="left")
        return out

    def goes_left(self, bins: np.ndarray, variable: int, at: int) -> np.ndarray:
        return bins[:, variable] == at if variable < len(self.sizes) else bins[:, variable] <= at

    def nodes(self, bins: np.ndarray, tree: Tree) -> np.ndarray:
        """The node that each row has reached in a tree."""
        node = np.zeros(len(bins), np.int64)
        for parent in sorted(tree.splits):
            here = np.flatnonzero(node == parent)
            if len(here):
                node[here] = 2 * parent + 2 - self.goes_left(bins[here], *tree.splits[parent])
        return node

    def added(self, margins: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> None:
        for c, tree in enumerate(trees):
            leaf = np.zeros(max(tree.values, default=0) + 1)
            leaf[list(tree.values)] = list(tree.values.values())
            margins[:, c] += leaf[self.nodes(bins, tree)]

    def predict(self, df: DataFrame, codes: list[str], numbers: list[str], output: str = "prediction") -> DataFrame:
        """Add the predicted number, or the code of the most likely class (ties: the first)."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(values: pa.Array) -> pa.Array:
            model = shared.value
            if not len(values):
                return pa.array([], pa.float64())
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            bins = model.binned(x[:, : len(model.sizes)], x[:, len(model.sizes) :])
            margins = np.full((len(x), max(model.classes, 1)), model.base)
            for trees in model.rounds:
                model.added(margins, bins, trees)
            return pa.array(margins.argmax(axis=1).astype(float) if model.classes else margins[:, 0])

        return df.withColumn(output, score(inputs_of(codes, numbers)))


def inputs_of(codes: list[str], numbers: list[str]) -> Column:
    """Codes (null: no level) and numbers (null: 0) of a row as one array."""
    return F.array(
        *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(-1.0)) for c in codes],
        *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in numbers],
    )


def cut_points(df: DataFrame, numbers: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Per column up to ``bins`` - 1 cuts at approximate quantiles; all values but the largest where there are fewer."""
    if not numbers:
        return []
    places = [i / bins for i in range(1, bins)]
    quantiles = [F.percentile_approx(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), places, ACCURACY).alias(f"q{i}") for i, c in enumerate(numbers)]
    tops = [F.max(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))).alias(f"m{i}") for i, c in enumerate(numbers)]
    row = df.agg(*quantiles, *tops).first()
    return [np.array([v for v in sorted(set(row[f"q{i}"] or [])) if v < row[f"m{i}"]]) for i in range(len(numbers))]


def _packed(rows: DataFrame, model: Boosted) -> DataFrame:
    """Blocks of rows: bins of every variable and targets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                bins = model.binned(x[:, : len(model.sizes)], x[:, len(model.sizes) :])
                y = piece.column("y").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()]), pa.array([y.astype(float).tobytes()])], ["bins", "y"])

    return rows.mapInArrow(pack, "bins binary, y binary")


def gradients(y: np.ndarray, margins: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by margin, per row and class."""
    if not classes:
        return margins - y[:, None], np.ones_like(margins)
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(classes)), np.maximum(2 * p * (1 - p), 1e-16)


def _histograms(model: Boosted, bins: np.ndarray, y: np.ndarray, margins: np.ndarray, trees: list[Tree], wanted: list[list[int]]) -> np.ndarray:
    """Sums (class and wanted node, bin of any variable, statistic) of a block, as one row."""
    first, second = gradients(y, margins, model.classes)
    starts = np.concatenate(([0], np.cumsum(model.widths)))
    out = []
    for c, nodes in enumerate(wanted):
        if not nodes:
            continue
        place = np.full(max(nodes) + 1, -1)
        place[nodes] = np.arange(len(nodes))
        node = model.nodes(bins, trees[c])
        slot = np.where(node <= max(nodes), place[np.minimum(node, max(nodes))], -1)
        some = np.flatnonzero(slot >= 0)
        sums = np.zeros((len(nodes), starts[-1], STATS))
        for v, width in enumerate(model.widths):
            cell = slot[some] * width + bins[some, v]
            for s, weight in enumerate((first[some, c], second[some, c], None)):
                sums[:, starts[v] : starts[v + 1], s] = np.bincount(cell, weight, len(nodes) * width).reshape(len(nodes), width)
        out.append(sums.reshape(1, -1))
    return np.concatenate(out, axis=1) if out else np.zeros((1, 0))


def best_split(model: Boosted, sums: np.ndarray) -> tuple[float, int, int]:
    """(gain, variable, bin) of the best split of a node; ties go to the first. Gain 0 means none."""
    starts = np.concatenate(([0], np.cumsum(model.widths)))
    total = sums[: starts[1]].sum(axis=0)
    best = (0.0, -1, -1)
    for v, width in enumerate(model.widths):
        part = sums[starts[v] : starts[v + 1]][: width - 1]
        left = part if v < len(model.sizes) else np.cumsum(part, axis=0)
        right = total - left
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + L2)
        gain = np.where((left[:, 1] >= MIN_WEIGHT) & (right[:, 1] >= MIN_WEIGHT), score(left) + score(right) - score(total), 0.0)
        if len(gain) and gain.max() > best[0] * (1 + 1e-12) + 1e-12:
            best = (float(gain.max()), v, int(gain.argmax()))
    return best


def fit_boosted(
    df: DataFrame, codes: list[str], sizes: list[int], numbers: list[str], target: str, classes: int = 0,
    rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP, bins: int = BINS,
) -> Boosted:
    """Fit on the rows of ``df``; ``classes`` 0 means squared error, otherwise ``target`` holds class codes.

    ``codes`` are columns of category codes with ``sizes`` levels: a split takes one level, like one of a one-hot column. Rows
    with a null target are left out. One job per level of a round, for all classes; lineage is cut every few rounds.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.where(F.col(f"`{target}`").isNotNull())
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.col(f"`{target}`").cast("double")).alias("mean")).first()
    if not stats["n"]:
        raise ValueError("there are no rows to fit trees on")
    model = Boosted(list(sizes), cut_points(rows, numbers, bins), classes, 0.0 if classes else stats["mean"], [])
    width, trees_a_round = sum(model.widths), max(classes, 1)
    if trees_a_round * 2 ** max(depth - 2, 0) * width * STATS * 8 > MAX_SUMS_BYTES:
        raise ValueError(f"{trees_a_round} classes and {width} bins are too many for a depth of {depth}")
    packed = _packed(rows.select(inputs_of(codes, numbers).alias("x"), F.col(f"`{target}`").cast("double").alias("y")), model)
    parts = min(packed.rdd.getNumPartitions(), -(-stats["n"] // PARTITION_ROWS))
    variables, outputs, base = len(model.widths), max(classes, 1), model.base

    def block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(row["y"])
        return np.frombuffer(row["bins"], np.int32).reshape(len(y), variables), y, np.full((len(y), outputs), base), np.zeros((1, 0))

    # the state is an RDD: a DataFrame's plan would hold those of all rounds before, and planning it takes twice as long each time
    state = packed.coalesce(parts).rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(sums: RDD, nodes: list[list[int]]) -> list[dict[int, np.ndarray]]:
        flat = array_sum(sums)[0]
        found, at = [], 0
        for some in nodes:
            found.append({})
            for node in some:
                found[-1][node] = flat[at : at + width * STATS].reshape(width, STATS)
                at += width * STATS
        return found

    def mapped(blocks: RDD, trees: list[Tree], nodes: list[list[int]], update: list[Tree] | None, carry: bool) -> RDD:
        """With ``carry`` the blocks after ``update``, with their sums; otherwise the sums of a task."""
        shared = spark.sparkContext.broadcast((model, trees, nodes, update))

        def run(items: Iterator[tuple]) -> Iterator:
            fitted, growing, asked, last = shared.value
            total = None
            for grid, y, margins, _ in items:
                if last:
                    margins = margins.copy()
                    fitted.added(margins, grid, last)
                sums = _histograms(fitted, grid, y, margins, growing, asked)
                if carry:
                    yield grid, y, margins, sums
                else:
                    total = sums if total is None else total + sums
            if total is not None:
                yield total

        return blocks.mapPartitions(run)

    for turn in range(rounds):
        trees = [Tree() for _ in range(trees_a_round)]
        nodes = [[0] for _ in trees]
        after = mapped(state, trees, nodes, model.rounds[-1] if model.rounds else None, True)
        after = after.persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            after.checkpoint()
        sums = summed(after.map(lambda held: held[3]), nodes)
        state.unpersist()
        state = after
        for level in range(depth):
            asked: list[list[int]] = []
            parents: list[dict[int, np.ndarray]] = []
            for tree, found in zip(trees, sums):
                asked.append([])
                parents.append({})
                for node, cells in found.items():
                    gain, variable, at = best_split(model, cells)
                    if gain <= 0:
                        continue
                    tree.splits[node] = (variable, at)
                    start = sum(model.widths[:variable])
                    own = cells[start : start + model.widths[variable]]
                    left = own[at] if variable < len(model.sizes) else own[: at + 1].sum(axis=0)
                    total = own.sum(axis=0)
                    for child, part in ((2 * node + 1, left), (2 * node + 2, total - left)):
                        tree.values[child] = -step * part[0] / (part[1] + L2)
                    tree.values.pop(node, None)
                    parents[-1][node] = cells
                    asked[-1].append(2 * node + 1 if left[2] * 2 <= total[2] else 2 * node + 2)
            if level == depth - 1 or not any(asked):
                break
            small = summed(mapped(state, trees, asked, None, False), asked)
            sums = []
            for c, some in enumerate(asked):
                sums.append({})
                for child in some:
                    other = child + 1 if child % 2 else child - 1
                    sums[c][child] = small[c][child]
                    sums[c][other] = parents[c][(child - 1) // 2] - small[c][child]
        for tree in trees:
            if not tree.splits:
                tree.values[0] = 0.0
        model.rounds.append(trees)
    state.unpersist()
    return model
