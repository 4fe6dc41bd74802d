"""Rounds and iterations add no layers to a query plan: planning such a plan takes twice as long with each of them."""

import numpy as np
import pytest

from rowloom.operators.blocks import array_sum
from rowloom.operators.boosting import fit_boosted
from rowloom.operators.kmeans import fit


@pytest.fixture
def layers(spark, monkeypatch):
    made, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (made.append(1), plain(self, *a, **b))[1])
    return made


def test_rounds_of_boosting_add_no_layers(spark, layers):
    df = spark.createDataFrame([(i % 3, float(i % 17), float((i * 7) % 11)) for i in range(200)], "c int, x double, y double").persist()
    counted = []
    for rounds in (1, 5):
        layers.clear()
        assert len(fit_boosted(df, ["c"], [3], ["x"], "y", rounds=rounds, depth=3).rounds) == rounds
        counted.append(len(layers))
    assert counted[0] == counted[1]


def test_iterations_of_kmeans_add_no_layers(spark, layers):
    points = np.random.default_rng(5).standard_normal((400, 3))
    df = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>").persist()
    counted = []
    for most in (1, 6):
        layers.clear()
        assert max(run.iterations for run in fit(df, "v", (3, 5), 2, max_iter=most).runs) == most
        counted.append(len(layers))
    assert counted[0] == counted[1]


def test_sums_of_many_tasks_are_always_the_same(spark):
    values = np.random.default_rng(1).standard_normal((60, 7)) * 10.0 ** np.arange(-3, 4)
    found = [array_sum(spark.sparkContext.parallelize(list(values), 30)) for _ in range(3)]
    assert np.allclose(found[0], values.sum(axis=0)) and all((f == found[0]).all() for f in found)
