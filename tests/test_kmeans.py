import numpy as np
import pytest

from rowloom.operators import kmeans


def table(spark, x):
    return spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)


def plain(x, centres):
    """Iterations over all distances from the same centres."""
    while True:
        a = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(-1)).argmin(axis=1)
        means = np.array([x[a == c].mean(axis=0) if (a == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(means, centres, atol=1e-12, rtol=0):
            return means, ((x - means[a]) ** 2).sum()
        centres = means


def test_runs_equal_plain_iterations(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((150, 3)) + c for c in rng.random((5, 3)) * 9])
    x[::3] = x[0]  # a third are copies
    blocks = kmeans.packed(table(spark, x), "v")
    first = kmeans.seeded(blocks, (2, 5), 2, 7)
    fitted = kmeans.fit(table(spark, x), "v", (2, 5), starts=2, seed=7)
    for began, run in zip(first, fitted.runs):
        centres, inertia = plain(x, began.centres)
        assert np.allclose(run.centres, centres) and run.inertia == pytest.approx(inertia)
    assert fitted.measured < 0.7 * fitted.plain
    for k in (2, 5):
        assert fitted.best[k].inertia == min(r.inertia for r in fitted.runs if r.k == k)


def test_restarts_find_the_blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9]], float)
    x = np.concatenate([c + 0.1 * rng.standard_normal((60, 2)) for c in centres])
    best = kmeans.fit(table(spark, x), "v", (4,), starts=3).best[4]
    assert sorted(np.round(best.centres).tolist()) == centres[np.lexsort((centres[:, 1], centres[:, 0]))].tolist()


@pytest.mark.parametrize("x", [np.ones((7, 2)), np.array([[1.0, 2.0]]), np.array([[0.0], [1.0]])])
def test_fewer_points_than_clusters(spark, x):
    run = kmeans.fit(table(spark, x), "v", (3,)).best[3]
    assert len(run.centres) == len(np.unique(x, axis=0)) and run.inertia == pytest.approx(0)


def test_no_rows(spark):
    with pytest.raises(ValueError):
        kmeans.fit(table(spark, np.ones((2, 2))).filter("v[0] > 5"), "v", (2,))
