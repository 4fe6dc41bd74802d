import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import boosting


def table(spark, c, x, y):
    rows = [(i, int(c[i]), float(x[i]), float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, c int, x double, y double").repartition(3)


def grown(one_hot, y, classes, rounds, depth, step=0.3):
    """Trees over all thresholds of all columns, node by node: the margins of the train rows."""
    n, k = len(y), max(classes, 1)
    margins = np.full((n, k), 0.0 if classes else y.mean())
    for _ in range(rounds):
        if classes:
            p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(k)), 2 * p * (1 - p)
        else:
            g, h = margins - y[:, None], np.ones((n, 1))
        for c in range(k):
            def split(rows, level):
                G, H = g[rows, c].sum(), h[rows, c].sum()
                best, at = 1e-12, None
                for j in range(one_hot.shape[1]):
                    for t in np.unique(one_hot[:, j])[:-1]:
                        left = one_hot[rows, j] <= t
                        hl, gl = h[rows[left], c].sum(), g[rows[left], c].sum()
                        if hl >= 1 and H - hl >= 1:
                            gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                            if gain > best + 1e-9:
                                best, at = gain, (j, t)
                if at is None or level == depth:
                    margins[rows, c] += -step * G / (H + 1) if level else 0.0
                    return
                side = one_hot[rows, at[0]] <= at[1]
                split(rows[side], level + 1)
                split(rows[~side], level + 1)

            split(np.arange(n), 0)
    return margins


@pytest.mark.parametrize("classes", [0, 3])
def test_trees_equal_brute_force(spark, classes):
    rng = np.random.default_rng(5)
    c, x = rng.integers(0, 4, 160), np.round(rng.random(160) * 20)
    y = x * 0.3 + (c == 2) * 5 + rng.random(160) if not classes else ((x > 9).astype(int) + (c == 1)).astype(float)
    df = table(spark, c, x, y)
    model = boosting.fit_boosted(df, ["c"], [4], ["x"], "y", classes, rounds=4, depth=3)
    wide = np.column_stack([*[(c == v).astype(float) for v in range(4)], x])
    margins = grown(wide, y, classes, 4, 3)
    got = np.array([r["p"] for r in model.predict(df, ["c"], ["x"], "p").orderBy("id").collect()])
    assert np.allclose(got, margins[:, 0], atol=1e-8) if not classes else (got == margins.argmax(axis=1)).mean() > 0.98


def test_levels_and_numbers_that_were_not_fitted(spark):
    df = table(spark, [0, 1] * 30, [1.0, 5.0] * 30, [0.0, 1.0] * 30)
    model = boosting.fit_boosted(df, ["c"], [2], ["x"], "y", 2, rounds=3)
    odd = df.limit(1).select(F.lit(None).cast("int").alias("c"), F.lit(None).cast("double").alias("x")).union(
        df.limit(1).select(F.lit(9).alias("c"), F.lit(1e9).alias("x")))
    assert [r["prediction"] for r in model.predict(odd, ["c"], ["x"]).collect()] in ([0.0, 1.0], [1.0, 1.0], [0.0, 0.0])
    with pytest.raises(ValueError):
        boosting.fit_boosted(df.filter("y > 3"), ["c"], [2], ["x"], "y")


def test_many_rounds_with_one_class_or_constant_rows(spark):
    df = table(spark, [0] * 40, [2.0] * 40, [1.0] * 40)
    model = boosting.fit_boosted(df, ["c"], [1], ["x"], "y", rounds=12)
    assert {r["prediction"] for r in model.predict(df, ["c"], ["x"]).collect()} == {1.0}
