"""Centroids, k-means over several k, and exact Euclidean silhouettes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.vectors import distance_error, doubles, matrix, paired_squares
from rowloom.operators.blocks import over_chunk_pairs, pair_chunks
from rowloom.operators.cells import nearest
from rowloom.operators.kmeans import Fit, fit
from rowloom.operators.knn import K_VALUES, choose_k, knn_join
from rowloom.operators.sampling import cached, subsample
from rowloom.session import ensure_checkpoint_dir

MAX_CENTROID_BYTES = 64 << 20
STARTS = 3
TILE_ROWS, TILE_COLUMNS = 256, 1024
EXACT_PAIRS = 1 << 16
#: Squared distances below so many error bounds are measured directly.
CANCELS = 1e6


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector and size per label, with map-side partial means: (label, centroid, n)."""
    return df.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(doubles(vector)))).alias("centroid"),
        F.count(F.lit(1)).alias("n"),
    )


def assign_nearest(df: DataFrame, centres: DataFrame, vector: str, label: str, centroid: str = "centroid",
                   output: str = "nearest", distance: str | None = "distance") -> DataFrame:
    """Add the label of the nearest centroid (ties: smallest label) and its Euclidean distance."""
    size = centres.agg(F.count("*"), F.max(F.size(centroid))).first()
    if size[0] * ((size[1] or 0) + 2) * 8 > MAX_CENTROID_BYTES:
        return _assign_by_join(df, centres, vector, label, centroid, output, distance)
    rows = centres.select(label, centroid).orderBy(label).toArrow()
    labels, points = rows.column(label).combine_chunks(), matrix(rows.column(centroid))
    kind = centres.schema[label].dataType.simpleString()

    @F.arrow_udf(f"struct<label:{kind},distance:double>")
    def lookup(vectors: pa.Array) -> pa.Array:
        block = matrix(vectors) if len(vectors) else np.zeros((0, points.shape[1]))
        best = nearest_rows(block, points)
        length = np.sqrt(((block - points[best]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays([labels.take(pa.array(best)), pa.array(length)], ["label", "distance"])

    found = df.withColumn("_near", lookup(doubles(vector))).withColumn(output, F.col("_near.label"))
    if distance:
        found = found.withColumn(distance, F.col("_near.distance"))
    return found.drop("_near")


def _assign_by_join(df: DataFrame, centres: DataFrame, vector: str, label: str, centroid: str, output: str, distance: str | None) -> DataFrame:
    """The same where the centroids are too large to send to every task: a kNN join with k = 1 on row numbers."""
    ensure_checkpoint_dir(df.sparkSession)
    numbered = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    renamed = centres.select(F.col(label).alias("_label"), F.col(centroid).alias(vector))
    found = knn_join(numbered, renamed, "_row", "_label", vector, k=1).withColumn("_near", F.col("neighbours")[0])
    found = found.withColumn(output, F.col("_near.key").cast(centres.schema[label].dataType))
    if distance:
        found = found.withColumn(distance, F.col("_near.distance"))
    return found.drop("_near", "_row", "neighbours")


def nearest_rows(block: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Index of the nearest point per row; ties go to the first."""
    return nearest(block, points, 1)[0][:, 0]


def _memberships(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicators (row, cluster of any clustering), and which clustering and cluster each column stands for."""
    members, which, cluster = [np.zeros((len(ids), 0))], [], []
    for w in range(ids.shape[1]):
        found, codes = np.unique(ids[:, w], return_inverse=True)
        hot = np.zeros((len(ids), len(found)))
        hot[np.arange(len(ids)), codes] = 1.0
        members.append(hot)
        which += [w] * len(found)
        cluster += found.tolist()
    return np.concatenate(members, axis=1), np.array(which, np.int32), np.array(cluster, np.int32)


def _distance_sums(
    a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, categories: int, same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the distances of each row of ``a`` to the members of each cluster of ``b``, and the other way round.

    A tile of distances is one matrix product that stays in a processor's cache and serves both sides. ``same``: b is a, so only tiles
    on and above the diagonal are measured and all sums are in the first result.
    """
    totals, others = np.zeros((len(a), of_b.shape[1])), np.zeros((len(b), of_a.shape[1]))
    if not len(a) or not len(b):
        return totals, others
    if same:
        others = totals
    centre = b[:, categories:].mean(axis=0)
    x, y = a[:, categories:] - centre, b[:, categories:] - centre
    left = np.concatenate((x, (x * x).sum(axis=1)[:, None], np.ones((len(a), 1))), axis=1)
    right = np.ascontiguousarray(np.concatenate((-2.0 * y, np.ones((len(b), 1)), (y * y).sum(axis=1)[:, None]), axis=1).T)
    near = CANCELS * distance_error(a, b, categories)
    turned = np.ascontiguousarray(of_a.T)
    for i in range(0, len(a), TILE_ROWS):
        rows = slice(i, min(len(a), i + TILE_ROWS))
        for j in range(i // TILE_COLUMNS * TILE_COLUMNS if same else 0, len(b), TILE_COLUMNS):
            columns = slice(j, min(len(b), j + TILE_COLUMNS))
            d = left[rows] @ right[:, columns]
            for c in range(categories):
                p, q = a[rows, c], b[columns, c]
                d += (p[:, None] != q[None, :]) * ((p >= 0)[:, None].astype(np.float64) + (q >= 0))
            cancels = d < near[rows, None]  # direct where the product form cancels
            if cancels.any():
                p, q = np.nonzero(cancels)
                for at in range(0, len(p), EXACT_PAIRS):
                    some = slice(at, at + EXACT_PAIRS)
                    d[p[some], q[some]] = paired_squares(a[i + p[some]], b[j + q[some]], categories)
            np.sqrt(d, out=d)
            if same and j < rows.stop:  # on the diagonal a pair counts once for each of its rows
                d[np.arange(j, columns.stop)[None, :] <= np.arange(i, rows.stop)[:, None]] = 0.0
            totals[rows] += d @ of_b[columns]
            others[columns] += (turned[:, rows] @ d).T
    return totals, others


def _sums_table(rows: pa.Table, own: np.ndarray, totals: np.ndarray, met: tuple[np.ndarray, np.ndarray, np.ndarray], names: list[str]) -> pa.Table:
    members, which, cluster = met
    n, width = totals.shape
    at = pa.array(np.repeat(np.arange(n), width))
    mine = own[:, which].reshape(-1) if width else np.zeros(0, np.int32)
    return pa.table(
        [
            rows.column("_key").combine_chunks().take(at),
            rows.column("_group").combine_chunks().take(at),
            pa.array(np.tile(which, n)),
            pa.array(mine),
            pa.array(np.tile(cluster, n)),
            pa.array(totals.reshape(-1)),
            pa.array(np.tile(members.sum(axis=0).astype(np.int64), n)),
        ],
        names,
    )


def cluster_distance_sums(
    df: DataFrame, key: str, vector: str, clusters: str, group: str | None = None, categories: int = 0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Sum of Euclidean distances from every row to the members of every cluster, and how many members there are.

    ``clusters`` is an array column with one cluster id per clustering, so several clusterings share one pass
    over the pairs; with ``group`` only rows of one group meet; the first ``categories`` entries of the vectors
    are codes that count as one-hot vectors. Result, hash-partitioned by key:
    (key, group, which, own, cluster, total, n).
    """
    size = df.agg(F.count("*"), F.max(F.size(vector))).first()
    chunks = pair_chunks(size[0], size[1] or 0, df.sparkSession.sparkContext.defaultParallelism, chunk_rows)
    grouped = F.col(group).cast("string") if group else F.lit("")
    side = df.select(
        F.col(key).alias("_key"), grouped.alias("_group"), doubles(vector).alias("v"), F.col(clusters).cast("array<int>").alias("c")
    )
    kind = side.schema["_key"].dataType.simpleString()
    names = ["_key", "_group", "which", "own", "cluster", "total", "n"]

    def work(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        if not len(left) or not len(right):
            left, right = left.slice(0, 0), right.slice(0, 0)
        if same:
            right = left
        a, b = matrix(left.column("v")), matrix(right.column("v"))
        own, ids = (matrix(t.column("c")).astype(np.int32) for t in (left, right))
        of_left, of_right = _memberships(own), _memberships(ids)
        totals, others = _distance_sums(a, b, of_left[0], of_right[0], categories, same)
        out = [_sums_table(left, own, totals, of_right, names)]
        return pa.concat_tables(out if same else [*out, _sums_table(right, ids, others, of_left, names)])

    schema = f"_key {kind}, _group string, which int, own int, cluster int, total double, n bigint"
    pairs = over_chunk_pairs(side, "_key", chunks, work, schema, ("_group",))
    return pairs.repartition("_key").groupBy(*names[:5]).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouettes(
    df: DataFrame, key: str, vector: str, clusters: str, group: str | None = None, categories: int = 0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Exact Euclidean silhouette of every row for every clustering: (key, group, which, cluster, silhouette).

    A row alone in its cluster scores 0; where there is only one cluster the silhouette is null.
    """
    same = F.col("cluster") == F.col("own")
    per_row = (
        cluster_distance_sums(df, key, vector, clusters, group, categories, chunk_rows)
        .groupBy("_key", "_group", "which", "own")
        .agg(
            F.max(F.when(same, F.col("n"))).alias("n"),
            F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
            F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
        )
    )
    value = F.when(F.col("n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per_row.select(
        F.col("_key").alias(key), F.col("_group").alias("group"), "which", F.col("own").alias("cluster"),
        F.when(F.col("b").isNotNull(), value).alias("silhouette"),
    )


def silhouette_score(
    df: DataFrame, key: str, vector: str, clusters: str, group: str | None = None, categories: int = 0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Mean silhouette per group and clustering: (group, which, score)."""
    rows = silhouettes(df, key, vector, clusters, group, categories, chunk_rows)
    return rows.groupBy("group", "which").agg(F.avg("silhouette").alias("score"))


def assign_all(df: DataFrame, vector: str, fitted: Fit, output: str = "clusters") -> DataFrame:
    """Add an array with the nearest centre of the best run of every k (ties: the first), in the order of the fit."""
    centres = [run.centres for run in fitted.best.values()]

    @F.arrow_udf("array<int>")
    def lookup(vectors: pa.Array) -> pa.Array:
        block = matrix(vectors) if len(vectors) else np.zeros((0, centres[0].shape[1]))
        found = np.stack([nearest_rows(block, c) for c in centres], axis=1).astype(np.int32)
        ends = np.arange(0, found.size + 1, len(centres), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))

    return df.withColumn(output, lookup(vector))


def kmeans_sweep(
    df: DataFrame,
    key: str,
    vector: str,
    ks: tuple[int, ...] = K_VALUES,
    seed: int = 0,
    max_train_rows: int | None = None,
    max_iter: int = 300,
    points: str | None = None,
    categories: int = 0,
    starts: int = STARTS,
) -> DataFrame:
    """k-means on distinct train vectors for every k, until the centres stay, chosen by validation silhouette.

    All k and ``starts`` run together; of the starts of a k the one with the lowest inertia counts. ``points`` names an ML vector
    column to cluster on where ``vector`` holds category codes. Result:
    (k, validation_score, test_score, chosen). A clustering that puts all validation rows into one cluster
    scores 0 there; on test the score is null.
    """
    features = vector_to_array(points) if points else doubles(vector)
    work = df.select(key, "split", doubles(vector).alias("v"), features.alias("features"))
    train = work.filter(F.col("split") == "train")
    if max_train_rows:
        train = subsample(train, key, max_train_rows, seed)
    fitted = fit(train.dropDuplicates(["v"]), "features", ks, starts, seed, max_iter)
    held = assign_all(work.filter(F.col("split").isin("validation", "test")), "features", fitted)
    held = cached(held.select(key, "split", "v", "clusters"))
    scored = silhouette_score(held, key, "v", "clusters", "split", categories).collect()
    held.unpersist()
    rows = [(ks[r["which"]], r["group"], r["score"] if r["group"] == "test" else r["score"] or 0.0) for r in scored]
    return choose_k(df.sparkSession.createDataFrame(rows, "k int, split string, score double"), greater=True)
