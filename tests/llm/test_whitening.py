import math
import random

import numpy as np
import pytest

from rowloom.llm import symmetric, whitening

SCHEMA = "vec_id long, embedding array<float>, x int, component string, n string, label int"


def brute(rows, k=16):
    """Whitened rows by the library's eigenpairs: {(key, deviation, component): (size of the coordinate, share)}."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) and abs(c) < whitening.LARGEST for c in v)]
    kept = [(i, x) for i, x in kept if len(x) == 6]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    covariance = d.T @ d / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in kept:
        exact = [n * c - s for c, s in zip(x, sums)]
        y = np.array([e / n for e in exact]) @ vectors / np.sqrt(values)
        out += [(i, c + 1, n, sum(e * e for e in exact), y[c], values[c] / np.trace(covariance)) for c in range(len(values))]
    return out


def vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [rows[7], (7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(500, None), (501, []), (502, [None] * 6), (503, [1.0] * 5 + [float("nan")]), (504, [float("inf")] + [0.0] * 5)]
    return rows + [(505, [float("-inf")] * 6), (506, [1.0] * 7), (507, [3e38] * 6), (508, [1.0] * 5 + [None])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 0) for r in rows], SCHEMA).repartition(5)


def test_whitening_equals_the_library(spark):
    rows = vectors()
    found = whitening.whitened(frame(spark, rows)).collect()
    wanted = brute(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    found, wanted = sorted(map(tuple, found), key=order), sorted(wanted, key=order)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    signs = {}
    for f, w in zip(found, wanted):
        if abs(w[4]) > 1e-3:
            signs.setdefault(f[1], set()).add(f[4] * w[4] > 0)
        assert abs(f[4]) == pytest.approx(abs(w[4]), abs=1e-9)
        assert f[5] == pytest.approx(w[5], rel=1e-9)
    assert all(len(s) == 1 for s in signs.values()) and len({r[6] for r in found}) == 1
    assert found[0][6] < 1e-9


def test_whitening_without_rows_or_variance(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [0.5] * 4)] * 3):
        table = whitening.whitened(frame(spark, rows))
        assert table.columns == columns and table.count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)]  # one direction only
    assert {r["component"] for r in whitening.whitened(frame(spark, line)).collect()} == {1}


def test_deviations_beyond_a_long_are_exact_or_null():
    centre = whitening.Centre(3_000_000_000, (3_000_000_000 * 5 + 1, -7))
    x = np.array([[10**10, 0], [5, 0]], np.int64)
    exact = [[3_000_000_000 * int(a) - s for a, s in zip(row, centre.sums)] for row in x]
    assert centre.deviations(x).tolist() == exact
    assert centre.squares(centre.deviations(x)) == [None, sum(e * e for e in exact[1])]


@pytest.mark.parametrize("name", ["random", "clusters", "close", "blocks", "low rank", "zero", "one", "tiny", "diagonal"])
def test_eigenpairs(name):
    rng = np.random.default_rng(2)
    b = rng.standard_normal((30, 40))
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    matrix = {
        "random": b @ b.T, "clusters": q @ np.diag([4.0] * 8 + [2.0] * 22) @ q.T, "close": q @ np.diag(1 + 1e-10 * np.arange(30)) @ q.T,
        "blocks": np.kron(np.eye(3), b[:10] @ b[:10].T), "low rank": b[:, :2] @ b[:, :2].T, "zero": np.zeros((4, 4)),
        "one": np.array([[2.0]]), "tiny": 1e-200 * b @ b.T, "diagonal": np.diag(np.arange(9.0)),
    }[name]
    values, vectors_ = symmetric.leading_pairs(matrix, 16)
    size = max(np.abs(matrix).max(), 1e-300)
    assert np.allclose(values / size, np.linalg.eigvalsh(matrix)[::-1][:16] / size, rtol=0, atol=1e-13)
    assert np.allclose(vectors_.T @ vectors_, np.eye(len(values)), atol=1e-13)
    assert np.allclose(matrix @ vectors_ / size, vectors_ * values / size, atol=1e-13)
