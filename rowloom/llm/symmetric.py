"""Leading eigenpairs of a symmetric matrix: reflections to three diagonals, bisection by sign counts, inverse iteration."""

from __future__ import annotations

import numpy as np

#: Eigenvalues nearer to each other than this share of the spectrum's bound are one cluster.
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)
ITERATIONS = 8


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, off-diagonal, reflectors) with T = Q' A Q, where Q is the product of the reflections in their order."""
    a = np.array(matrix, float)
    n, reflectors, off = len(a), [], []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if not np.any(v[1:]):
            off.append(v[0])
            continue
        off.append(-np.copysign(length, v[0]))
        v[0] -= off[-1]
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = 2 * (rest @ v)
        p -= v * (v @ p)
        rest -= np.outer(p, v) + np.outer(v, p)
        reflectors.append((k + 1, v))
    if n > 1:
        off.append(a[n - 1, n - 2])
    return np.diagonal(a).copy(), np.array(off, float), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, floor: float) -> np.ndarray:
    """Number of eigenvalues below each shift: the negative pivots of the shifted matrix."""
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        pivot = d - shifts - e * e / np.where(np.abs(pivot) < floor, np.copysign(floor, pivot), pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each to the last bits of the matrix's norm."""
    n = len(diagonal)
    radius = np.abs(np.concatenate((off, [0]))) + np.abs(np.concatenate(([0], off)))
    low, high = np.min(diagonal - radius), np.max(diagonal + radius)
    bound = max(abs(low), abs(high), np.finfo(float).tiny)
    floor = bound * EPS * EPS + np.finfo(float).tiny
    lows, highs = np.full(k, low - 2 * n * EPS * bound), np.full(k, high + 2 * n * EPS * bound)
    wanted = n - 1 - np.arange(k)
    while True:
        middle = (lows + highs) / 2
        if np.all((middle <= lows) | (middle >= highs) | (highs - lows <= EPS * np.maximum(np.abs(middle), EPS * bound))):
            return middle
        under = below(diagonal, off, middle, floor) > wanted
        highs, lows = np.where(under, middle, highs), np.where(under, lows, middle)


def _eliminated(diagonal: np.ndarray, off: np.ndarray, shift: float, floor: float):
    """Rows of the shifted matrix reduced to an upper triangle, exchanging neighbours for the larger pivot."""
    n = len(diagonal)
    main, first, second = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    factors, swapped = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        below_main, below_first = off[i], first[i + 1]
        if abs(below_main) > abs(main[i]):
            swapped[i] = True
            factors[i] = main[i] / below_main
            row = (below_main, main[i + 1], below_first)
            main[i + 1], first[i + 1] = first[i] - factors[i] * main[i + 1], -factors[i] * below_first
            main[i], first[i], second[i] = row
        else:
            if abs(main[i]) < floor:
                main[i] = floor
            factors[i] = below_main / main[i]
            main[i + 1] -= factors[i] * first[i]
    main[-1] = main[-1] if abs(main[-1]) >= floor else floor
    return main, first, second, factors, swapped


def _solved(parts, right: np.ndarray) -> np.ndarray:
    main, first, second, factors, swapped = parts
    y = right.copy()
    n = len(y)
    for i in range(n - 1):
        if swapped[i]:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= factors[i] * y[i]
    for i in range(n - 1, -1, -1):
        ahead = first[i] * y[i + 1] if i + 1 < n else 0.0
        if i + 2 < n:
            ahead += second[i] * y[i + 2]
        y[i] = (y[i] - ahead) / main[i]
        top = abs(y[i])
        if top > 1e150:
            y /= top
    return y


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector for each value (falling), as columns; within a cluster each is kept orthogonal to the earlier."""
    n = len(diagonal)
    bound = max(float(np.max(np.abs(diagonal))) + 2 * float(np.max(np.abs(off), initial=0)), np.finfo(float).tiny)
    floor = EPS * bound
    rng = np.random.default_rng(1)
    out: list[np.ndarray] = []
    start, shift = 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * bound:
            start = i
        shift = min(value, shift - 2 * floor) if i > start else value
        parts = _eliminated(diagonal, off, shift, floor)
        y = rng.standard_normal(n)
        for _ in range(ITERATIONS):
            y = _solved(parts, y / np.linalg.norm(y))
            for _ in range(2):
                for z in out[start:i]:
                    y -= z * (z @ y)
            length = np.linalg.norm(y)
            if length * floor < EPS:
                y = rng.standard_normal(n)
        out.append(y / np.linalg.norm(y))
    return np.array(out).T.reshape(n, len(values))


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns, whose largest entry is positive."""
    n = len(matrix)
    k = min(k, n)
    scale = float(np.max(np.abs(matrix), initial=0))
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = vectors_of(diagonal, off, values)
    for at, v in reversed(reflectors):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    top = np.take_along_axis(vectors, np.argmax(np.abs(vectors), axis=0)[None, :], axis=0)
    return values * scale, vectors * np.where(top < 0, -1.0, 1.0)
