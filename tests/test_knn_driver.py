"""A train side that is too large to be collected stays on the executors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import knn


def test_large_train_side_is_not_collected(spark, monkeypatch):
    """50 MB of vectors, as the train customers of a 1 GB table have twice."""
    monkeypatch.setattr(knn, "_broadcast_join", lambda *args: pytest.fail("the train side came to the driver"))
    vector = F.array(*[F.xxhash64("id", F.lit(i % 3)) / float(1 << 63) * (1 + i) for i in range(16)])
    train = spark.range(350_000).select("id", vector.alias("v")).persist()
    asked = train.filter("id % 50000 = 0")
    found = {r["id"]: r["neighbours"] for r in knn.knn_join(asked, train, "id", "id", "v", k=5).collect()}
    points = np.array([r["v"] for r in train.select("v").toArrow().to_pylist()])
    for r in asked.collect():
        d = ((points - np.array(r["v"])) ** 2).sum(axis=1)
        assert np.allclose([n["d2"] for n in found[r["id"]]], np.sort(d)[:5], atol=1e-8)
    train.unpersist()
