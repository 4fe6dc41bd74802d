"""Hashes that Spark and other SQL engines compute alike, so that splits and samples can be reproduced."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32
SPLIT_BOUNDS = (("train", 8100), ("validation", 9000), ("test", 10000))


def hash32(*parts: Column | str) -> Column:
    """First 32 bits of the MD5 of the parts joined by ``|``, as a long."""
    columns = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    joined = columns[0] if len(columns) == 1 else F.concat_ws("|", *columns)
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def hash32_sql(*parts: str) -> str:
    """The same hash as SQL text in the dialect of the test oracle."""
    joined = parts[0] if len(parts) == 1 else "concat_ws('|', " + ", ".join(parts) + ")"
    return f"CAST('0x' || substr(md5(CAST({joined} AS VARCHAR)), 1, 8) AS BIGINT)"


def split_name(*parts: Column | str) -> Column:
    """train / validation / test with shares 81 / 9 / 10 percent, by key hash."""
    bucket = hash32(*parts) % 10000
    (first, low), (second, high), (last, _) = SPLIT_BOUNDS
    return F.when(bucket < low, first).when(bucket < high, second).otherwise(last)


def split_sql(*parts: str) -> str:
    bucket = f"{hash32_sql(*parts)} % 10000"
    (first, low), (second, high), (last, _) = SPLIT_BOUNDS
    return f"CASE WHEN {bucket} < {low} THEN '{first}' WHEN {bucket} < {high} THEN '{second}' ELSE '{last}' END"


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotated(state + word * _P2, 31) * _P1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _short_word(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotated(h ^ (word * _P1), 23) * _P2 + _P3


def xxhash64_of(values: list[bytes], seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of byte strings, as longs; strings of one length at a time."""
    out = np.zeros(len(values), np.uint64)
    sizes = np.array([len(v) for v in values], np.int64)
    with np.errstate(over="ignore"):
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            data = np.frombuffer(b"".join([values[i] for i in some]), np.uint8).reshape(len(some), size)
            words = np.ascontiguousarray(data[:, : size // 8 * 8]).view("<u8").astype(np.uint64)
            start, at = np.full(len(some), seed, np.int64).astype(np.uint64), 0
            if size >= 32:
                states = [start + _P1 + _P2, start + _P2, start, start - _P1]
                for at in range(0, size // 32 * 4, 4):
                    states = [_round(v, words[:, at + j]) for j, v in enumerate(states)]
                at = size // 32 * 4
                h = sum((_rotated(v, bits) for v, bits in zip(states[1:], (7, 12, 18))), _rotated(states[0], 1))
                for v in states:
                    h = (h ^ _round(np.zeros_like(v), v)) * _P1 + _P4
            else:
                h = start + _P5
            h = h + np.uint64(size)
            for j in range(at, words.shape[1]):
                h = _rotated(h ^ _round(np.zeros_like(h), words[:, j]), 27) * _P1 + _P4
            rest = size // 8 * 8
            if size - rest >= 4:
                h = _short_word(h, np.ascontiguousarray(data[:, rest : rest + 4]).view("<u4")[:, 0].astype(np.uint64))
                rest += 4
            for j in range(rest, size):
                h = _rotated(h ^ (data[:, j].astype(np.uint64) * _P5), 11) * _P1
            out[some] = _mixed(h)
    return out.view(np.int64)


def chained_xxhash64(hashes: np.ndarray, number: int) -> np.ndarray:
    """``xxhash64(value, number)`` for an integer, from the hashes of the values."""
    with np.errstate(over="ignore"):
        h = hashes.view(np.uint64) + _P5 + np.uint64(4)
        return _mixed(_short_word(h, np.full(len(h), number & 0xFFFFFFFF, np.uint64))).view(np.int64)
