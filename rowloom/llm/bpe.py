"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import each_text
from rowloom.llm.pretokens import PLAIN, UNSURE_SPACE, PreTokens, pre_tokens

#: Words and pre-tokens that a worker remembers, of up to so many characters each; then it starts afresh.
WORDS, PARTS, REMEMBERED_CHARS = 300_000, 600_000, 40
#: Characters of texts encoded together, and the longest pre-tokens whose trees are kept side by side.
TOGETHER, SIDE_BY_SIDE = 2_000_000, 64
#: Above every rank and place.
NONE = 1 << 62
PAIR = 20


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Codec:
    """Text to ids and back for one byte-level BPE file."""

    def __init__(self, split: PreTokens):
        model = split.spec["model"]
        if model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("plain merges are expected")
        self.pre = split
        alphabet = byte_alphabet()
        vocabulary = model["vocab"]
        self.of_byte = [vocabulary[alphabet[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left << PAIR | right) to (rank << PAIR | merged)
        self.merges = {vocabulary[a] << PAIR | vocabulary[b]: rank << PAIR | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        back = {c: b for b, c in alphabet.items()}
        size = max([*vocabulary.values(), *split.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in split.special.items():
            self.bytes_of[i] = token.encode()
        self.digits = [str(i) for i in range(size)]
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        values = np.fromiter(self.merges.values(), np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], values[order] >> PAIR
        self.merged_of = np.zeros(int(self.pair_ranks.max(initial=0)) + 1, np.int64)
        self.merged_of[self.pair_ranks] = values[order] & ((1 << PAIR) - 1)
        self.byte_ids = np.array(self.of_byte, np.int64)
        self.ids = list(range(size))  # shared objects, so that remembered ids take no memory of their own
        self.words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token. Leaf i holds (rank, i, merged id) of the pair that starts at i; the root is the leftmost
        lowest-rank pair; a merge updates three leaves on their ways to the root."""
        n = len(data)
        ids = [self.of_byte[b] for b in data]
        if n < 2:
            return tuple(ids)
        merges = self.merges.get
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        shift = n.bit_length()
        low = (1 << shift) - 1
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            m = merges(ids[i] << PAIR | ids[i + 1])
            if m is not None:
                tree[size + i] = (m >> PAIR) << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        if tree[1] == NONE:
            return tuple(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (top := tree[1]) != NONE:
            at = top & low
            gone = after[at]
            ids[at] = merges(ids[at] << PAIR | ids[gone]) & ((1 << PAIR) - 1)
            ids[gone] = -1
            right, left = after[gone], before[at]
            after[at] = right
            m = None
            if right < n:
                before[right] = at
                m = merges(ids[at] << PAIR | ids[right])
            changes = [(gone, NONE), (at, NONE if m is None else (m >> PAIR) << shift | at)]
            if left >= 0:
                m = merges(ids[left] << PAIR | ids[at])
                changes.append((left, NONE if m is None else (m >> PAIR) << shift | left))
            for leaf, value in changes:
                i = size + leaf
                if i >= 2 * size or tree[i] == value:
                    continue
                tree[i] = value
                while i > 1:
                    a, b = tree[i], tree[i ^ 1]
                    i >>= 1
                    value = a if a < b else b
                    if tree[i] == value:
                        break
                    tree[i] = value
        return tuple([i for i in ids if i >= 0])

    def pair_values(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair merges, and its rank."""
        key = left << PAIR | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return self.pair_keys[at] == key, self.pair_ranks[at]

    def merge_many(self, words: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """``merge`` for words whose trees have the same number of leaves, one merge of every word at a time."""
        rows, shift = len(words), leaves.bit_length() + 1
        low = (1 << shift) - 1
        sizes = np.fromiter(map(len, words), np.int64, rows)
        ids = np.full((rows, leaves + 2), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        inside = np.arange(leaves + 2) < sizes[:, None]
        ids[inside] = self.byte_ids[flat]
        tree = np.full((rows, 2 * leaves), NONE, np.int64)
        hit, rank = self.pair_values(ids[:, :leaves], ids[:, 1:leaves + 1])
        hit &= inside[:, 1:leaves + 1]
        tree[:, leaves:] = np.where(hit, rank << shift | np.arange(leaves), NONE)
        for i in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        after = np.tile(np.arange(1, leaves + 3), (rows, 1))
        before = np.tile(np.arange(-1, leaves + 1), (rows, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)
        while live.size:
            top = tree[live, 1]
            at = top & low
            gone = after[live, at]
            merged = self.merged_of[top >> shift]
            ids[live, at] = merged
            ids[live, gone] = -1
            right, left = after[live, gone], before[live, at]
            after[live, at] = right
            before[live, right] = at
            hit, rank = self.pair_values(merged, ids[live, right])
            with_right = np.where(hit & (right < sizes[live]), rank << shift | at, NONE)
            hit, rank = self.pair_values(ids[live, left], merged)
            with_left = np.where(hit & (left >= 0), rank << shift | left, NONE)
            for leaf, value in ((gone, NONE), (at, with_right), (left, with_left)):
                # no pair starts at the last byte, and none before the first
                node = np.where((leaf >= 0) & (leaf < leaves), leaf + leaves, 0)
                tree[live, node] = value
                while (node > 1).any():
                    node >>= 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, np.maximum(2 * node + 1, 1)])
            live = live[tree[live, 1] != NONE]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(1)).tolist()
        found = list(map(self.ids.__getitem__, ids[kept].tolist()))
        return [tuple(found[a:b]) for a, b in zip([0, *ends], ends)]

    def learn(self, pre_tokens: set[str]) -> None:
        by_leaves: dict[int, list[str]] = {}
        for part in pre_tokens:
            n = len(part.encode())
            if n > SIDE_BY_SIDE:
                self.parts[part] = tuple([self.ids[i] for i in self.merge(part.encode())])
            else:
                by_leaves.setdefault(1 << max(0, n - 2).bit_length() if n > 2 else 1, []).append(part)
        for leaves, parts in by_leaves.items():
            self.parts.update(zip(parts, self.merge_many([p.encode() for p in parts], leaves)))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of several texts. What follows a space, up to the next space, splits on its own where no other white space
        is near, so such words are remembered whole; elsewhere pre-tokens are."""
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.parts) > PARTS:
            self.parts.clear()
        jobs: list[list[tuple[int | None, list[str], list[str]]]] = []
        wanted: set[str] = set()
        fresh: dict[str, list[str]] = {}
        for text in texts:
            job = []
            for i, segment in enumerate(self.pre.segments(text)):
                if i % 2:
                    job.append((self.pre.special[segment], [], []))
                    continue
                if UNSURE_SPACE.search(segment) or not self.pre.plain(segment):
                    parts, rest = self.pre.split(segment), []
                else:
                    first, *rest = segment.split(" ")
                    parts = PLAIN.findall(first)
                    for word in set(rest).difference(self.words):
                        if word not in fresh:
                            fresh[word] = PLAIN.findall(" " + word)
                            wanted.update(fresh[word])
                wanted.update(parts)
                job.append((None, parts, rest))
            jobs.append(job)
        self.learn(wanted.difference(self.parts))
        part_of = self.parts.__getitem__
        for word, parts in fresh.items():
            self.words[word] = tuple(chain.from_iterable(map(part_of, parts)))
        word_of, out = self.words.__getitem__, []
        for job in jobs:
            ids: list[int] = []
            for special, parts, rest in job:
                if special is not None:
                    ids.append(special)
                ids += chain.from_iterable(map(part_of, parts))
                ids += chain.from_iterable(map(word_of, rest))
            out.append(ids)
        for memory, used in ((self.words, fresh), (self.parts, wanted)):
            for text in [t for t in used if len(t) > REMEMBERED_CHARS]:
                memory.pop(text, None)
        return out

    def encode_each(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, in groups of bounded size; null counts as empty."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > TOGETHER:
                yield from self.encode_all(group)
                group, size = [], 0
        yield from self.encode_all(group)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(pre_tokens(path))


@contextmanager
def task_codec(path: str) -> Iterator[Codec]:
    """The worker's codec for one task: workers outlive tasks and serve other stages, so what it remembered goes at the end."""
    both = codec(path)
    try:
        yield both
    finally:
        both.words, both.parts = {}, {}
        gc.collect()


def _typed(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def encoded(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Rows (key, ids); null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as both:
            for batch in batches:
                ids = list(both.encode_each(each_text(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["_key", "ids"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {_typed(docs, key)}, ids array<int>").withColumnRenamed("_key", key)


def decoded(tokens: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """Rows (key, text); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            texts = [decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_key", "text"])

    rows = tokens.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    return rows.mapInArrow(run, f"_key {_typed(tokens, key)}, text string").withColumnRenamed("_key", key)


def round_trip(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): every text encoded, decoded from its ids, and digested in one
    pass. Null texts count as empty; repeated rows are rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as both:
            digits = both.digits.__getitem__
            for batch in batches:
                sizes, first, second = [], [], []
                for ids in both.encode_each(each_text(batch.column(1))):
                    sizes.append(len(ids))
                    first.append(sha256(",".join(map(digits, ids)).encode()).hexdigest())
                    second.append(sha256(both.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    ["_key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {_typed(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)
