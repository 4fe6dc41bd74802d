"""All-pairs distance sums: every pair of rows is measured once, in enough tasks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.functions.vectors import paired_squares
from rowloom.operators import cluster
from rowloom.operators.blocks import over_chunk_pairs, pair_chunks


def test_every_pair_of_rows_meets_once(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("g"))

    def work(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        n = len(left) * (len(left) - 1) // 2 if same else len(left) * len(right)
        return pa.table({"n": pa.array([n], pa.int64())})

    sizes = [167, 167, 166]
    met = over_chunk_pairs(df, "id", 4, work, "n long", ("g",)).agg(F.sum("n")).first()[0]
    assert met == sum(n * (n - 1) // 2 for n in sizes)


def test_many_rows_make_pairs_for_every_core():
    for rows in (50_000, 600_000, 10_000_000):
        chunks = pair_chunks(rows, 64, 6)
        assert chunks * (chunks + 1) // 2 >= 18
    assert pair_chunks(2_000, 64, 6) == 1


@pytest.mark.parametrize("categories", [0, 2])
def test_tiles_equal_brute_force(categories):
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((2500, 5))
    rows[:, :categories] = rng.integers(-1, 4, (2500, categories))
    rows[10], rows[11] = rows[2000], rows[2001] + 1e-9 * (np.arange(5) >= categories)
    ids = rng.integers(0, 4, (2500, 2)).astype(np.int32)
    distances = np.sqrt(np.stack([paired_squares(np.repeat(r[None], len(rows), 0), rows, categories) for r in rows]))
    whole = cluster._memberships(ids)[0]
    sums, _ = cluster._distance_sums(rows, rows, whole, whole, categories, True)
    assert np.allclose(sums, distances @ whole, rtol=1e-12)
    some, rest = (cluster._memberships(part)[0] for part in (ids[:900], ids[900:]))
    sums, others = cluster._distance_sums(rows[:900], rows[900:], some, rest, categories, False)
    assert np.allclose(sums, distances[:900, 900:] @ rest, rtol=1e-12)
    assert np.allclose(others, distances[900:, :900] @ some, rtol=1e-12)
