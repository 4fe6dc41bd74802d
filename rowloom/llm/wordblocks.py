"""Word and shingle hashes of many texts at a time, over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text whose words are hashed together.
BLOCK = 1 << 19
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(seed: int) -> np.uint64:
    return mix(np.array([seed], np.uint64))[0] | np.uint64(1)


_BASE = odd(1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_VALUE[_BLANK] = 0
_LOWER = _VALUE.copy()
_LOWER[0x41:0x5B] = _VALUE[0x61:0x7B]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, BLOCK).bit_length()
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _BACK):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[size] = tuple(tables)
    return _powers[size]


def word_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words in a byte array: polynomials in an odd base over the bytes."""
    inside = np.concatenate(([False], ~_BLANK[data], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    power, back = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _VALUE)[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * STEP), starts, ends


def blocks(texts: Iterable[str | None], lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, word hashes, word offsets of the texts) for groups of texts; a very long text is
    hashed in pieces cut at blanks, so memory follows the block and not the text."""
    group: list[bytes] = []
    first = size = 0
    for text in texts:
        data = (text or "").encode()
        if group and size + len(data) > BLOCK:
            yield first, len(group), *_hash_group(group, lower)
            first, group, size = first + len(group), [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield first, len(group), *_hash_group(group, lower)


def _hash_group(group: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    if len(group) == 1 and len(group[0]) > 2 * BLOCK:
        hashes = np.concatenate([word_hashes(np.frombuffer(p, np.uint8), lower)[0] for p in _pieces(group[0])])
        return hashes, np.array([0, len(hashes)])
    hashes, starts, _ = word_hashes(np.frombuffer(b" ".join(group), np.uint8), lower)
    places = np.cumsum([0, *[len(d) + 1 for d in group]])
    return hashes, np.searchsorted(starts, places)


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words; the runs of a shorter array are none."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = total * _BASE + hashes[i:i + n]
    return mix(total)


def shingle_sets(texts: Iterable[str | None], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, shingles, offsets): the sorted distinct shingle hashes of each lower-cased text. A text with fewer
    words is one shingle; one without words has none."""
    for first, n, hashes, ends in blocks(texts, lower=True):
        runs = windows(hashes, length)
        sets = []
        for i in range(n):
            a, b = ends[i], ends[i + 1]
            if b - a >= length:
                sets.append(np.unique(runs[a:b - length + 1]))
            else:
                sets.append(windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        yield first, np.concatenate(sets), np.cumsum([0, *map(len, sets)])
