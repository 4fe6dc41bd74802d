"""Exact k-nearest-neighbour join, and the evaluation of every k from one join."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rowloom.functions.vectors import doubles, matrix
from rowloom.operators.blocks import chunk_count
from rowloom.operators.cells import DISTANCE_DIGITS, Cells, may_hold, pivot_distances
from rowloom.operators.metrics import balanced_accuracy, mse
from rowloom.operators.sampling import subsample
from rowloom.session import ensure_checkpoint_dir

#: The driver sorts, groups and sends what it broadcasts, and so holds it several times.
MAX_BROADCAST_BYTES = 48 << 20
#: Beyond it every core gets a few cells, as long as they hold so many points.
CELLS_PER_CORE = 3
LEAST_CELL_ROWS = 1 << 14
#: Pivots that every task holds, at most; cells grow beyond that and are cut by key hash.
MAX_PIVOTS = 4096
MAX_PIVOT_BYTES = 16 << 20
K_VALUES = tuple(range(2, 11))  # fixed value: the k tried by the sweeps


def _neighbours(key_type: str) -> str:
    return f"array<struct<d2:double,key:{key_type},y:double,distance:double>>"


def _neighbour_array(place: np.ndarray, rounded: np.ndarray, distance: np.ndarray, keys: pa.Array, targets: np.ndarray) -> pa.Array:
    found = place < len(targets)
    flat = place[found]
    cells = pa.StructArray.from_arrays(
        [pa.array(rounded[found]), keys.take(pa.array(flat)), pa.array(targets[flat]), pa.array(distance[found])],
        ["d2", "key", "y", "distance"],
    )
    ends = np.concatenate(([0], np.cumsum(found.sum(axis=1))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), cells)


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    query_key: str,
    train_key: str,
    vector: str,
    target: str | None = None,
    k: int = 10,
    categories: int = 0,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``neighbours`` to ``queries``: the k nearest rows of ``train``, nearest first, as (d2, key, y, distance);
    ``d2`` is the squared distance to nine digits, which decides ties.

    Points are grouped around pivots with radii, and only groups that the triangle inequality cannot rule out meet a
    query. Where its measured size is below the bound the train side is broadcast as such cells. Otherwise it is
    dealt to cells on the executors; queries go to the nearest cells first, and then only to those that can hold
    something nearer. The first ``categories`` entries of the vectors are codes that count as one-hot vectors.
    """
    points = train.select(
        (F.col(train_key).cast("long") if isinstance(train.schema[train_key].dataType, IntegralType) else F.col(train_key)).alias("key"),
        doubles(vector).alias("v"),
        (F.col(target).cast("double") if target else F.lit(None).cast("double")).alias("y"),
    )
    rows, first = points.count(), points.select(F.size("v")).first()
    if first is None:
        raise ValueError("the train side of the kNN join has no rows")
    if rows * (first[0] + 2) * 8 <= max_broadcast_bytes:
        return _broadcast_join(queries, points, vector, k, categories)
    bins = chunk_count(rows, first[0], chunk_rows)
    if chunk_rows is None:
        bins = max(bins, min(CELLS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism, rows // LEAST_CELL_ROWS))
    return _cell_join(queries, points, query_key, vector, k, categories, bins, -(-rows // bins))


def _sorted_points(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    table = table.sort_by("key")
    y = table.column("y").to_numpy().astype(np.float64) if table.column("y").null_count < len(table) else np.full(len(table), np.nan)
    return matrix(table.column("v")), table.column("key").combine_chunks(), y


def _broadcast_join(queries: DataFrame, points: DataFrame, vector: str, k: int, categories: int) -> DataFrame:
    values, keys, targets = _sorted_points(points.toArrow())
    shared = queries.sparkSession.sparkContext.broadcast((Cells.of(values, categories), keys, targets))

    @F.arrow_udf(_neighbours(points.schema["key"].dataType.simpleString()))
    def search(vectors: pa.Array) -> pa.Array:
        cells, names, numbers = shared.value
        block = matrix(vectors) if len(vectors) else np.zeros((0, cells.points.shape[1]))
        return _neighbour_array(*cells.nearest(block, k), names, numbers)

    return queries.withColumn("neighbours", search(doubles(vector)))


def _literal(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _share(key: str, shares: Column) -> Column:
    return F.pmod(F.xxhash64(key), shares)


def _cell_join(
    queries: DataFrame, points: DataFrame, query_key: str, vector: str, k: int, categories: int, bins: int, bin_rows: int
) -> DataFrame:
    """The join where the train side is too large for every task: in two rounds over cells that stay on the executors.

    Each task gets at most about ``bin_rows`` points and queries of one cell: larger cells, such as one of many copies, are cut by
    key hash. A query is copied once per cell that can hold one of its neighbours.
    """
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    left = queries.select(F.col(query_key).alias("_q"), doubles(vector).alias("v"))
    width = points.select(F.size("v")).first()[0]
    count = max(1, min(2 * bins, MAX_PIVOTS, MAX_PIVOT_BYTES // (8 * max(1, width))))
    pivots = np.unique(matrix(points.orderBy(F.xxhash64("key")).select("v").limit(count).toArrow().column("v")), axis=0)

    @F.arrow_udf("struct<cell:int,radius:double>")
    def place(vectors: pa.Array) -> pa.Array:
        d = pivot_distances(matrix(vectors), pivots, categories)[0] if len(vectors) else np.zeros((0, len(pivots)))
        return pa.StructArray.from_arrays([pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], ["cell", "radius"])

    placed = points.withColumn("_at", place("v")).select("key", "v", "y", "_at.cell", "_at.radius").checkpoint()
    sizes, low, high = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect():
        sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    slack_of_cells = 1e-12 * np.max(high, initial=0.0, where=np.isfinite(high))

    def bounded(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, error = pivot_distances(block, pivots, categories)
        return d, np.maximum(np.maximum(d - high, low - d), 0.0), 2 * error + slack_of_cells

    def listed(chosen: np.ndarray) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(chosen.sum(axis=1)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(chosen)[1].astype(np.int32)))

    def home(block: np.ndarray) -> np.ndarray:
        d, bounds, _ = bounded(block)
        score = np.where(sizes > 0, bounds + 1e-3 * d, np.inf)
        order = np.argsort(score, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        chosen = np.zeros(order.shape, bool)
        np.put_along_axis(chosen, order, (before < k) & (sizes[order] > 0), axis=1)
        return chosen

    @F.arrow_udf("array<int>")
    def first_cells(vectors: pa.Array) -> pa.Array:
        return listed(home(matrix(vectors)) if len(vectors) else np.zeros((0, len(pivots)), bool))

    @F.arrow_udf("array<int>")
    def other_cells(vectors: pa.Array, kth: pa.Array) -> pa.Array:
        if not len(vectors):
            return listed(np.zeros((0, len(pivots)), bool))
        block = matrix(vectors)
        _, bounds, slack = bounded(block)
        return listed(may_hold(bounds, kth.to_numpy(zero_copy_only=False), slack) & (sizes > 0) & ~home(block))

    def searched(asked: DataFrame) -> DataFrame:
        """Of ``(_q, v, kth, cell)`` the points of the cell no farther than ``kth``: (_q, found)."""
        asks = np.zeros(len(pivots), np.int64)
        for r in asked.groupBy("cell").count().collect():
            asks[r["cell"]] = r["count"]
        parts = F.get(_literal((-(-sizes // bin_rows)).tolist()), F.col("cell"))
        shares = F.get(_literal((-(-asks // bin_rows)).tolist()), F.col("cell"))
        some = asked.select("*", _share("_q", shares).alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        others = placed.where(shares > 0).select(
            "key", "v", "y", "cell", _share("key", parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share")
        )
        by = ("cell", "part", "share")
        key_type, found_type = left.schema["_q"].dataType.simpleString(), _neighbours(points.schema["key"].dataType.simpleString())
        return some.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(search, f"_q {key_type}, found {found_type}")

    def search(some: pa.Table, others: pa.Table) -> pa.Table:
        if not len(some) or not len(others):
            fields = [("d2", pa.float64()), ("key", others.schema.field("key").type), ("y", pa.float64()), ("distance", pa.float64())]
            return pa.table({"_q": some.column("_q").slice(0, 0), "found": pa.array([], pa.list_(pa.struct(fields)))})
        values, keys, targets = _sorted_points(others)
        kth = some.column("kth").to_numpy()
        places, rounded, distance = Cells.of(values, categories).nearest(matrix(some.column("v")), k, kth)
        places[rounded > kth[:, None]] = np.iinfo(np.int64).max
        return pa.table({"_q": some.column("_q"), "found": _neighbour_array(places, rounded, distance, keys, targets)})

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("_q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))

    no_bound = F.lit(float("inf"))
    near = merged(searched(left.select("_q", "v", no_bound.alias("kth"), F.explode(first_cells("v")).alias("cell")))).checkpoint()
    kth = F.coalesce(F.get(F.col("found"), F.lit(k - 1))["d2"], no_bound)
    again = left.join(near.select("_q", kth.alias("kth")), "_q").select("_q", "v", "kth", F.explode(other_cells("v", "kth")).alias("cell")).checkpoint()
    best = merged(near.unionByName(searched(again)))
    return queries.join(best.select(F.col("_q").alias(query_key), F.col("found").alias("neighbours")), query_key, "left")


def votes(neighbours: Column | str, k: int | Column) -> Column:
    """Most frequent class among the first k neighbours; ties go to the smallest class."""
    column = F.col(neighbours) if isinstance(neighbours, str) else neighbours
    first = F.transform(F.slice(column, 1, k), lambda x: x["y"])
    ranked = F.transform(
        F.array_distinct(first),
        lambda c: F.struct(F.size(F.filter(first, lambda x: x == c)).alias("n"), (-c).alias("minus")),
    )
    return -F.array_max(ranked)["minus"]


def means(neighbours: Column | str, k: int | Column) -> Column:
    """Mean target of the first k neighbours."""
    column = F.col(neighbours) if isinstance(neighbours, str) else neighbours
    first = F.slice(column, 1, k)
    return F.aggregate(first, F.lit(0.0), lambda total, x: total + x["y"]) / F.size(first)


def predictions(joined: DataFrame, target: str, task: str, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """Long form (split, k, y, prediction) from one join at the greatest k."""
    rule = votes if task == "classification" else means
    per_k = F.array(*[F.struct(F.lit(k).alias("k"), rule("neighbours", k).alias("prediction")) for k in ks])
    return joined.select("split", F.col(target).cast("double").alias("y"), F.inline(per_k))


def knn_sweep(
    df: DataFrame,
    key: str,
    vector: str,
    target: str,
    task: str,
    ks: tuple[int, ...] = K_VALUES,
    max_train_rows: int | None = None,
    **options,
) -> DataFrame:
    """Validation and test score of every k and the chosen k: (k, validation_score, test_score, chosen).

    ``df`` has a ``split`` column. The best validation score wins, the smaller k on ties; the score is
    balanced accuracy for classes and mean squared error for numbers. All train rows take part unless
    ``max_train_rows`` asks for a hash sample.
    """
    queries = df.filter(F.col("split").isin("validation", "test")).select(key, "split", vector, target)
    train = df.filter(F.col("split") == "train").select(key, vector, target)
    if max_train_rows:
        train = subsample(train, key, max_train_rows)
    joined = knn_join(queries, train, key, key, vector, target, max(ks), **options)
    scored = predictions(joined, target, task, ks)
    score = balanced_accuracy if task == "classification" else mse
    return choose_k(score(scored, "y", "prediction", ["k", "split"]), greater=task == "classification")


def choose_k(scores: DataFrame, greater: bool) -> DataFrame:
    """From (k, split, score) rows to one row per k with the chosen k marked; ties keep the smaller k."""
    wide = scores.groupBy("k").agg(
        *[F.max(F.when(F.col("split") == s, F.col("score"))).alias(f"{s}_score") for s in ("validation", "test")]
    )
    merit = F.col("validation_score") if greater else -F.col("validation_score")
    tried = wide.agg(
        F.collect_list(F.struct("k", "validation_score", "test_score")).alias("tried"),
        F.max_by("k", F.struct(merit, -F.col("k"))).alias("best"),
    )
    return tried.select("best", F.inline("tried")).select(
        "k", "validation_score", "test_score", (F.col("k") == F.col("best")).alias("chosen")
    )
