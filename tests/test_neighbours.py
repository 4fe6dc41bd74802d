import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions.vectors import squared_distances
from rowloom.operators.cluster import assign_nearest, centroids, kmeans_sweep, nearest_rows, silhouette_score, silhouettes
from rowloom.operators.cells import Cells, nearest
from rowloom.operators.knn import choose_k, knn_join, knn_sweep, means, votes
from rowloom.operators.metrics import balanced_accuracy, imputation_scores, rounded_labels


def table(spark, x, y=None, split=None):
    rows = [(i, v.tolist(), int(y[i]) if y is not None else 0, split[i] if split is not None else "train") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int, split string")


def brute(queries, points, k):
    d = np.round(((queries[:, None, :] - points[None, :, :]) ** 2).sum(-1), 9)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_nearest_resolves_ties_by_position():
    rng = np.random.default_rng(0)
    points = np.concatenate([np.zeros((40, 3)), rng.integers(0, 3, (60, 3)).astype(float)])
    queries = rng.integers(0, 3, (25, 3)).astype(float)
    for k in (1, 3, 10, 200):
        assert (nearest(queries, points, k)[0] == brute(queries, points, k)).all()


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0, "chunk_rows": 37}])
def test_join_equals_brute_force_with_a_third_of_copies(spark, options):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 4))
    x[::3] = x[0]
    df = table(spark, x)
    found = knn_join(df.filter("id >= 150"), df.filter("id < 150"), "id", "id", "v", "y", 7, **options)
    got = {r["id"]: [n["key"] for n in r["neighbours"]] for r in found.collect()}
    expected = brute(x[150:], x[:150], 7)
    assert got == {150 + i: row.tolist() for i, row in enumerate(expected)}


def odd_points(name):
    rng = np.random.default_rng(8)
    grid = rng.integers(0, 5, (1500, 3)).astype(float)
    return {
        "spread": (rng.random((300, 3)), rng.random((4000, 3)), 0),
        "ties": (grid[:200], grid, 0),
        "copies": (grid[:200], np.concatenate([np.zeros((1500, 3)), grid[:90]]), 0),
        "wide": (rng.standard_normal((100, 64)), rng.standard_normal((900, 64)), 0),
        "codes": (grid[:100] - 1, grid - 1, 2),
        "far": (1e9 + np.round(grid[:200] * 7.3, 2), 1e9 + np.round(grid * 7.3, 2), 0),
        "raw": (rng.random((200, 2)) * [5e5, 1e4] + [0, 1e8], rng.random((3000, 2)) * [5e5, 1e4] + [0, 1e8], 0),
        "one": (grid[:4], grid[:1], 0),
    }[name]


@pytest.mark.parametrize("name", ["spread", "ties", "copies", "wide", "codes", "far", "raw", "one"])
def test_cells_equal_all_pairs(name):
    queries, points, categories = odd_points(name)
    cells = Cells.of(points, categories, ring_rows=40)
    wanted, found = nearest(queries, points, 6, categories), cells.nearest(queries, 6)
    assert (wanted[0] == found[0]).all() and (wanted[1] == found[1]).all() and np.allclose(wanted[2], found[2])
    if name in ("spread", "raw"):
        assert cells.pairs < 0.2 * len(queries) * len(points)


@pytest.mark.parametrize("name", ["spread", "ties", "copies", "codes", "raw"])
def test_cell_join_equals_all_pairs(spark, name):
    queries, points, categories = odd_points(name)
    queries, points = queries[:60], points[:700]
    train = spark.createDataFrame([(i, v.tolist(), float(i % 5)) for i, v in enumerate(points)], "id long, v array<double>, y double")
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "name string, v array<double>")
    found = knn_join(asked, train, "name", "id", "v", "y", 6, categories, max_broadcast_bytes=0, chunk_rows=90)
    got = {r["name"]: [(n["key"], n["y"], n["d2"]) for n in r["neighbours"]] for r in found.collect()}
    index, rounded, _ = nearest(queries, points, 6, categories)
    assert got == {f"q{i}": [(int(j), float(j % 5), d) for j, d in zip(row, rounded[i])] for i, row in enumerate(index)}


def test_votes_and_means(spark):
    df = spark.createDataFrame([([(0.1, 1, 2.0), (0.2, 2, 1.0), (0.3, 3, 1.0), (0.4, 4, 2.0)],)], "n array<struct<d2:double,key:bigint,y:double>>")
    row = df.select(*[votes("n", k).alias(f"v{k}") for k in (1, 2, 3, 4)], means("n", 3).alias("m")).first()
    assert (row.v1, row.v2, row.v3, row.v4) == (2.0, 1.0, 1.0, 1.0) and row.m == pytest.approx(4 / 3)


def test_sweep_chooses_smallest_best_k(spark):
    scores = spark.createDataFrame([(2, "validation", 0.5), (3, "validation", 0.7), (4, "validation", 0.7), (3, "test", 0.6)], "k int, split string, score double")
    best = choose_k(scores, greater=True).filter("chosen").collect()
    assert [(r.k, r.test_score) for r in best] == [(3, 0.6)]
    assert choose_k(scores, greater=False).filter("chosen").first().k == 2


def test_sweep_separates_blobs(spark):
    rng = np.random.default_rng(2)
    y = np.arange(240) % 3
    x = np.array([[0, 0], [5, 0], [0, 5]])[y] + 0.2 * rng.standard_normal((240, 2))
    split = np.where(np.arange(240) < 160, "train", np.where(np.arange(240) < 200, "validation", "test"))
    df = table(spark, x, y, split)
    assert knn_sweep(df, "id", "v", "y", "classification").filter("chosen").first().test_score == 1.0
    sampled = knn_sweep(df, "id", "v", "y", "classification", max_train_rows=50).filter("chosen").first()
    assert sampled.test_score == 1.0
    best = kmeans_sweep(df, "id", "v", ks=(2, 3, 4)).filter("chosen").first()
    assert best.k == 3 and best.test_score > 0.9


def numpy_silhouettes(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = np.zeros(len(x))
    for i in range(len(x)):
        own = (labels == labels[i]) & (np.arange(len(x)) != i)
        if not own.any():
            continue
        a = d[i][own].mean()
        b = min(d[i][labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
        out[i] = (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("chunk", [8192, 29])
def test_silhouettes_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 3))
    x[:40] = x[0]  # a third are copies
    first, second = rng.integers(0, 3, 120), np.zeros(120, int)
    first[7] = 9  # alone in its cluster
    df = table(spark, x).join(
        spark.createDataFrame([(i, [int(first[i]), int(second[i])]) for i in range(120)], "id long, c array<int>"), "id"
    )
    rows = silhouettes(df, "id", "v", "c", chunk_rows=chunk).collect()
    got = {r["id"]: r["silhouette"] for r in rows if r["which"] == 0}
    expected = numpy_silhouettes(x, first)
    assert np.allclose([got[i] for i in range(120)], expected, atol=1e-9)
    assert all(r["silhouette"] is None for r in rows if r["which"] == 1)


def test_codes_count_as_one_hot_vectors(spark):
    rng = np.random.default_rng(6)
    codes, numbers = rng.integers(-1, 4, (50, 2)).astype(float), rng.standard_normal((50, 1))
    wide = np.concatenate([(codes[:, [c]] == np.arange(4)).astype(float) for c in range(2)] + [numbers], axis=1)
    narrow = np.concatenate([codes, numbers], axis=1)
    expected = ((wide[:, None] - wide[None]) ** 2).sum(-1)
    assert np.allclose(squared_distances(narrow, narrow, 2), expected)
    labels = rng.integers(0, 3, 50)
    df = table(spark, narrow, labels).withColumn("c", F.array("y"))
    got = {r["id"]: r["silhouette"] for r in silhouettes(df, "id", "v", "c", categories=2, chunk_rows=20).collect()}
    assert np.allclose([got[i] for i in range(50)], numpy_silhouettes(wide, labels))
    found = knn_join(df, df, "id", "id", "v", k=4, categories=2)
    assert {r["id"]: [n["key"] for n in r["neighbours"]] for r in found.collect()} == {i: row.tolist() for i, row in enumerate(brute(wide, wide, 4))}


def test_silhouette_groups_do_not_meet(spark):
    rng = np.random.default_rng(4)
    x, labels = rng.standard_normal((60, 2)), rng.integers(0, 2, 60)
    df = table(spark, x, labels, np.where(np.arange(60) < 30, "a", "b")).withColumn("c", F.array("y"))
    got = {r["group"]: r["score"] for r in silhouette_score(df, "id", "v", "c", "split").collect()}
    assert got["a"] == pytest.approx(numpy_silhouettes(x[:30], labels[:30]).mean())
    assert got["b"] == pytest.approx(numpy_silhouettes(x[30:], labels[30:]).mean())


def test_centroids_and_nearest(spark):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((90, 3)), rng.integers(0, 4, 90)
    df = table(spark, x, y)
    centres = {r["y"]: np.array(r["centroid"]) for r in centroids(df, "y", "v").collect()}
    for c in range(4):
        assert np.allclose(centres[c], x[y == c].mean(axis=0))
    order = np.stack([centres[c] for c in range(4)])
    found = {r["id"]: (r["nearest"], r["distance"]) for r in assign_nearest(df, centroids(df, "y", "v"), "v", "y").collect()}
    d = np.sqrt(((x[:, None] - order[None]) ** 2).sum(-1))
    assert all(found[i][0] == d[i].argmin() and found[i][1] == pytest.approx(d[i].min()) for i in range(90))


def test_balanced_accuracy_weighs_classes_equally(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4), (0, 1.0), (1, 1.4)], "y int, p double")
    assert balanced_accuracy(rounded_labels(df, "p"), "y", "p").first()["score"] == pytest.approx((2 / 3 + 1) / 2)


def test_imputation_scope(spark):
    rows = [(0, "k", "cat", 1.0, 1.0), (1, "k", "cat", 1.0, 0.0), (0, "x", "num", 1.0, 3.0), (1, "x", "num", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "batch_id long, variable string, kind string, truth double, estimate double")
    mean = {r["variable"]: r["score"] for r in imputation_scores(df).collect()}
    last = {r["variable"]: r["score"] for r in imputation_scores(df, scope="last_batch").collect()}
    assert mean == {"k": 0.5, "x": 2.0} and last == {"k": 0.0, "x": 0.0}


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_neighbours_are_exact_far_from_zero(offset):
    rng = np.random.default_rng(3)
    points = offset + np.round(rng.random((300, 3)) * 50, 2)
    queries = offset + np.round(rng.random((80, 3)) * 50, 2)
    direct = ((queries[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    wanted = np.lexsort((np.broadcast_to(np.arange(300), direct.shape), np.round(direct, 9)), axis=1)[:, :5]
    assert (nearest(queries, points, 5)[0] == wanted).all()
    assert (nearest_rows(queries, points) == wanted[:, 0]).all()


def test_string_keys_and_many_centroids(spark, monkeypatch):
    from rowloom.operators import cluster

    df = spark.createDataFrame([(f"k{i}", [float(i), 0.0]) for i in range(30)], "id string, v array<double>")
    near = knn_join(df, df, "id", "id", "v", k=2).collect()
    assert all(r["neighbours"][0]["key"] == r["id"] for r in near)
    centres = spark.createDataFrame([(i, [3.0 * i, 0.0]) for i in range(10)], "label int, centroid array<double>")
    plain = {r["id"]: (r["nearest"], r["distance"]) for r in cluster.assign_nearest(df, centres, "v", "label").collect()}
    monkeypatch.setattr(cluster, "MAX_CENTROID_BYTES", 0)
    assert {r["id"]: (r["nearest"], r["distance"]) for r in cluster.assign_nearest(df, centres, "v", "label").collect()} == plain
