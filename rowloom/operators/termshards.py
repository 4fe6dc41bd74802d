"""Word counts of texts cut by shards of terms, and the leading components of them from a Krylov basis that stays in the shards.

Documents fall into groups by key, terms into shards by a checksum. A shard holds the counts of its terms, group by group, and
its rows of every block of the basis. A pass sends each shard's part of the scores to the groups, and their sums back; what reaches
the driver are matrices as wide as the basis.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.hashing import chained_xxhash64, xxhash64_of
from rowloom.functions.text import tokens

#: Text bytes of a group of documents, at most; and at least, as long as some core has no group.
GROUP_BYTES = 8 << 20
LEAST_GROUP_BYTES = 1 << 20
#: A shard holds at least so many terms, if there are as many.
SHARD_TERMS = 1 << 16
LEAST_SHARD_TERMS = 64
#: Vocabularies beyond this many terms, added over the groups, are estimated from one checksum in SAMPLED.
COUNTED_TERMS = 1 << 20
SAMPLED = 64
SLICE_CELLS = 1 << 14
_GROUP = "grp int, terms int, sample binary, cells binary, keys binary"


def _place(at: int) -> int:
    return at


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def group_count(text_bytes: int, cores: int) -> int:
    return max(1, math.ceil(text_bytes / GROUP_BYTES), min(cores, text_bytes // LEAST_GROUP_BYTES))


def document_groups(df: DataFrame, key: str, text: str, groups: int) -> DataFrame:
    """The counts of every (key, token), a row per group of documents; rows of one key are one document, also those without a key."""
    dealt = df.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition(groups, "key")
    return dealt.select("key", tokens("text").alias("tokens")).mapInArrow(_grouped, _GROUP)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    keys, sizes, words = [], [], []
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("tokens")
            keys.append(batch.column("key"))
            sizes.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            words.append(lists.flatten().dictionary_encode())
    if not keys:
        return
    docs = pa.chunked_array(keys).combine_chunks().dictionary_encode("encode")
    found = pa.chunked_array(words).unify_dictionaries().combine_chunks()
    terms = found.dictionary.cast(pa.binary())
    row = np.repeat(docs.indices.to_numpy().astype(np.int64), np.concatenate(sizes))
    cells, n = np.unique(row * len(terms) + found.indices.to_numpy(), return_counts=True)
    doc, code = np.divmod(cells, max(1, len(terms)))
    check = np.array([zlib.crc32(t) for t in terms.to_pylist()], np.uint32)
    packed = pickle.dumps((terms, check, _small(doc), _small(code), _small(n), len(docs.dictionary)), 5)
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(terms)], pa.int32()),
         pa.array([check[check % SAMPLED == 0].tobytes()]), pa.array([packed]), pa.array([pickle.dumps(docs.dictionary, 5)])],
        ["grp", "terms", "sample", "cells", "keys"],
    )


def shard_count(groups: DataFrame, columns: int, max_block_bytes: int) -> int:
    """Shards so that a block of the basis has at most ``max_block_bytes`` in each, and every core has one where it is worth a task."""
    sizes = groups.select("terms", "sample").toArrow()
    held = sum(sizes.column("terms").to_pylist())
    if held > COUNTED_TERMS:
        held = SAMPLED * len(np.unique(np.frombuffer(b"".join(sizes.column("sample").to_pylist()), np.uint32)))
    wanted = max(
        min(groups.sparkSession.sparkContext.defaultParallelism, math.ceil(held / SHARD_TERMS)),
        math.ceil(held * columns * 8 / max(1, max_block_bytes)),
    )
    return max(1, min(wanted, math.ceil(held / LEAST_SHARD_TERMS)))


def _split(row, shards: int, with_keys: bool) -> Iterator[tuple]:
    """(shard, (group, documents, keys, terms, document, term, count of each cell)); one shard of a group gets its keys."""
    terms, check, doc, code, n, docs = pickle.loads(row["cells"])
    group, shard = row["grp"], check % shards
    by = np.argsort(shard, kind="stable")
    starts = np.searchsorted(shard[by], np.arange(shards + 1))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by)) - starts[shard[by]]
    of_cell = _small(shard)[code]
    order = np.argsort(of_cell, kind="stable")
    cuts = np.searchsorted(of_cell[order], np.arange(shards + 1))
    for s in range(shards):
        some = order[cuts[s] : cuts[s + 1]]
        keys = bytes(row["keys"]) if with_keys and s == group % shards else None
        if len(some) or keys is not None:
            own = terms.take(pa.array(by[starts[s] : starts[s + 1]]))
            yield s, (group, docs, keys, own, doc[some], _small(place[code[some]]), n[some])


def _sharded(groups: DataFrame, shards: int, with_keys: bool) -> RDD:
    rows = groups.select("grp", "cells", "keys") if with_keys else groups.select("grp", "cells")
    return rows.rdd.flatMap(lambda row: _split(row, shards, with_keys)).partitionBy(shards, _place)


def _together(*parts: RDD) -> RDD:
    """Shards that lie in the same partitions, one part after the other."""
    out = parts[0].context.union(list(parts))
    if out.getNumPartitions() != parts[0].getNumPartitions():
        raise RuntimeError("the shards do not lie in the same partitions")
    return out


def _aligned(parts: list[RDD], work: Callable) -> RDD:
    """(shard, work(values)) of the one value that every part has of a shard; ``work`` gets them one after the other."""

    def run(items: Iterator[tuple]) -> Iterator[tuple]:
        for shard, value in items:
            yield shard, work(chain((value,), (v for _, v in items)))
            return

    return _together(*parts).mapPartitions(run, preservesPartitioning=True)


def _kept(rdd: RDD) -> RDD:
    return rdd.persist(StorageLevel.MEMORY_AND_DISK)


def _numbered(items: Iterator[tuple]) -> Iterator[tuple]:
    """Of each shard first its (terms, counts), then the cells of every group by document and by term."""
    held = list(items)
    if not held:
        return
    words = pa.chunked_array([value[3] for _, value in held]).combine_chunks().dictionary_encode()
    own, total, at = words.indices.to_numpy(), np.zeros(len(words.dictionary)), 0
    for _, (_, _, _, terms, _, code, n) in held:
        total += np.bincount(own[at + code.astype(np.int64)], n, len(total))
        at += len(terms)
    yield held[0][0], (words.dictionary, total)
    for _ in range(len(held)):
        shard, (group, docs, _, terms, doc, code, n) = held.pop()
        at -= len(terms)
        code = own[at + code.astype(np.int64)]
        order = np.argsort(code, kind="stable")
        present, rows = np.unique(doc, return_index=True)
        found, columns = np.unique(code[order], return_index=True)
        places = [a.astype(np.int32) for a in (rows, columns, found)]
        yield shard, (group, docs, (code, n, places[0], present), (doc[order], n[order], *places[1:]))


def _first(items: Iterator[tuple], work: Callable) -> Iterator[tuple]:
    for shard, value in items:
        yield shard, work(value)
        return


def _add_runs(table: np.ndarray, at: np.ndarray, n: np.ndarray, starts: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """out[rows] += the sums of table[at] * n over the runs that begin at ``starts``."""
    ends, first = np.append(starts, len(at)), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_CELLS, side="right")) - 1)
        part = slice(ends[first], ends[last])
        out[rows[first:last]] += np.add.reduceat(table[at[part]] * n[part, None], ends[first:last] - ends[first], axis=0)
        first = last


def _product(counts: RDD, block: RDD, shift: np.ndarray, shards: int, groups: int) -> RDD:
    """Xc' Xc block for the centred counts Xc: (shard, rows).

    The scores Xc block add up to zero over all documents, so X' may stand for Xc' on the left.
    """

    def forward(items: Iterator[tuple]) -> Iterator[tuple]:
        table = None
        for _, value in items:
            if table is None:
                table = value
            elif len(value) == 4:
                group, docs, (code, n, starts, present), _ = value
                part = np.zeros((docs, table.shape[1]))
                _add_runs(table, code, n, starts, present, part)
                yield group, part

    def scores(items: Iterator[tuple]) -> Iterator[tuple]:
        for group, total in _sums(items).items():
            total -= shift
            for s in range(shards):
                yield s, (group, total)

    def back(items: Iterator[tuple]) -> Iterator[tuple]:
        held, total, shard = {}, None, 0
        for shard, value in items:
            if len(value) == 4:
                group, _, _, (doc, n, starts, found) = value
                _add_runs(held[group], doc, n, starts, found, total)
            elif isinstance(value[0], int):
                held[value[0]] = value[1]
            else:
                total = np.zeros((len(value[0]), len(shift)))
        if total is not None:
            yield shard, total

    sums = _together(block, counts).mapPartitions(forward).partitionBy(groups, _place).mapPartitions(scores)
    return _together(sums.partitionBy(shards, _place), counts).mapPartitions(back, preservesPartitioning=True)


def _sums(items: Iterator[tuple]) -> dict:
    total: dict = {}
    for group, part in items:
        if group in total:
            total[group] += part
        else:
            total[group] = part
    return total


def _start_block(terms: pa.Array, k: int, seed: int) -> np.ndarray:
    """Rows of a first basis from token hashes."""
    named = xxhash64_of(terms.to_pylist())
    return np.stack([chained_xxhash64(named, seed * k + i) / float(1 << 63) for i in range(k)], axis=1)


def leading_loadings(
    groups: DataFrame, state_of: Callable, n_docs: int, columns: int, width: int, seed: int, max_block_bytes: int
) -> tuple[RDD | None, list[float], int, int, int]:
    """((shard, (terms, loadings)), projected mean, shards, terms, passes) of the centred counts of packed groups of ``n_docs`` documents.

    ``state_of`` gives the Krylov state for a block's width.
    """
    shards, places = shard_count(groups, columns, max_block_bytes), max(1, groups.rdd.getNumPartitions())
    counts = _kept(_sharded(groups, shards, False).mapPartitions(_numbered, preservesPartitioning=True))
    means = _kept(counts.mapPartitions(lambda items: _first(items, lambda v: v[1] / n_docs), preservesPartitioning=True))
    n_terms = means.map(lambda v: len(v[1])).sum()
    counts._jrdd.rdd().cleanShuffleDependencies(False)
    k = min(columns, n_terms, max(1, n_docs))
    if not k:
        return None, [], shards, 0, 0
    held: list[RDD] = []

    def keep(rdd: RDD) -> RDD:
        held.append(_kept(rdd))
        return rdd

    def drop(*rdds: RDD) -> None:
        for rdd in rdds:
            rdd.unpersist()
            held.remove(rdd)

    def triangle(block: RDD) -> tuple[np.ndarray, np.ndarray]:
        """R of the tall matrix, by QR of each shard's rows and of the stacked triangles, and its product with the means."""

        def work(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            a, mean = parts
            return np.linalg.qr(a, mode="r"), mean @ a

        found = _aligned([block, means], work).values().collect()
        return np.linalg.qr(np.concatenate([r for r, _ in found]), mode="r"), np.sum([m for _, m in found], axis=0)

    def turned(parts: list[RDD], turn: np.ndarray) -> RDD:
        def work(blocks: Iterator[np.ndarray]) -> np.ndarray:
            total, at = 0.0, 0
            for b in blocks:
                total = total + b @ turn[at : at + b.shape[1]]
                at += b.shape[1]
            return total

        return _aligned(parts, work)

    def orthonormal(block: RDD) -> tuple[RDD, np.ndarray]:
        """An orthonormal basis of the block's columns and its product with the means."""
        for _ in range(2):
            upper, mean = triangle(block)
            axes = np.linalg.pinv(upper)
            new = keep(turned([block], axes))
            new.count()
            drop(block)
            block = new
        return block, mean @ axes

    def inner(block: RDD, parts: list[RDD]) -> np.ndarray:
        def work(blocks: Iterator[np.ndarray]) -> np.ndarray:
            a = next(blocks)
            return np.concatenate([b.T @ a for b in blocks])

        return np.sum(_aligned([block, *parts], work).values().collect(), axis=0)

    def less(block: RDD, parts: list[RDD], products: np.ndarray) -> RDD:
        def work(blocks: Iterator[np.ndarray]) -> np.ndarray:
            rest, at = next(blocks).copy(), 0
            for b in blocks:
                rest -= b @ products[at : at + b.shape[1]]
                at += b.shape[1]
            return rest

        return keep(_aligned([block, *parts], work))

    first = counts.mapPartitions(lambda items: _first(items, lambda v: _start_block(v[0], k, seed)), preservesPartitioning=True)
    block, shift = orthonormal(keep(first))
    basis, state = [block], state_of(k)
    while True:
        raw = keep(_product(counts, basis[-1], shift, shards, places))
        products = inner(raw, basis)
        raw._jrdd.rdd().cleanShuffleDependencies(False)
        once = less(raw, basis, products)
        again = inner(once, basis)  # twice, so that rounding does not bring earlier directions back
        left = less(once, basis, again)
        rest, mean = triangle(left)
        drop(raw, once)
        if state.step(products + again, rest):
            break
        if state.full():
            turn = state.restarted()
            whole, mean = orthonormal(keep(turned(basis, turn)))
            whole.checkpoint()
            settled = turn.shape[1] - state.last
            cuts = [lambda a: next(a)[:, :settled].copy(), lambda a: next(a)[:, settled:].copy()]
            new = [keep(_aligned([whole], cut)) for cut in (cuts if settled else cuts[1:])]
            for part in new:
                part.count()
            drop(whole, left, *basis)
            basis, shift = new, mean[settled:]
            continue
        axes, sizes, _ = np.linalg.svd(rest.T, full_matrices=False)  # directions of the rest, without the idle ones
        some = sizes > 1e-10 * state.scale
        axes = axes[:, some] / sizes[some]
        basis.append(keep(turned([left], axes)))
        basis[-1].count()
        shift = mean @ axes
        drop(left)
        state.grown(int(some.sum()))
    names = counts.mapPartitions(lambda items: _first(items, lambda v: v[0]), preservesPartitioning=True)
    loadings = keep(turned(basis, state.turn[:, :width]))

    def tops_of(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, mean = parts
        return a[np.abs(a).argmax(axis=0), np.arange(a.shape[1])], mean @ a

    found = _aligned([loadings, means], tops_of).values().collect()
    tops = np.array([top for top, _ in found])
    signs = np.where(tops[np.abs(tops).argmax(axis=0), np.arange(tops.shape[1])] < 0, -1.0, 1.0)
    offset = (np.sum([mean for _, mean in found], axis=0) * signs).tolist()
    table = _kept(_aligned([names, loadings], lambda a: (next(a), next(a) * signs)))
    table.count()
    drop(*held)
    for rdd in (counts, means):
        rdd.unpersist()
    return table, offset, shards, n_terms, state.passes


def projected(df: DataFrame, key: str, text: str, table: RDD, shards: int, width: int, output: str) -> DataFrame:
    """(key, output): the counts of every document times the loadings; words outside the vocabulary count nothing."""
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    groups = document_groups(df, key, text, group_count(size, df.sparkSession.sparkContext.defaultParallelism))
    places = max(1, groups.rdd.getNumPartitions())

    def forward(items: Iterator[tuple]) -> Iterator[tuple]:
        held = [value for _, value in items]
        if not held:
            return
        vocabulary, loadings = held[0] if len(held[0]) == 2 else (pa.array([], pa.binary()), np.zeros((0, width)))
        asked = [value for value in held if len(value) == 7]
        if not asked:
            return
        words = pa.chunked_array([value[3] for value in asked]).combine_chunks()
        own = pc.fill_null(pc.index_in(words, value_set=vocabulary), len(vocabulary)).to_numpy(zero_copy_only=False)
        rows, at = np.concatenate((loadings, np.zeros((1, width)))), 0
        for group, docs, keys, terms, doc, code, n in asked:
            present, starts = np.unique(doc, return_index=True)
            part = np.zeros((docs, width))
            _add_runs(rows, own[at + code.astype(np.int64)], n, starts, present, part)
            at += len(terms)
            yield group, (keys, part)

    def totals(items: Iterator[tuple]) -> Iterator[tuple]:
        keys: dict = {}

        def parts() -> Iterator[tuple]:
            for group, (named, part) in items:
                if named is not None:
                    keys[group] = named
                yield group, part

        for group, total in _sums(parts()).items():
            yield keys[group], total.tobytes()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rowloom.functions.vectors import vector_array

        for batch in batches:
            for named, sums in zip(batch.column("keys").to_pylist(), batch.column("sums").to_pylist()):
                keys = pickle.loads(named)
                yield pa.RecordBatch.from_arrays([keys, vector_array(np.frombuffer(sums).reshape(len(keys), width))], [key, output])

    parts = _together(table, _sharded(groups, shards, True)).mapPartitions(forward).partitionBy(places, _place)
    spark = df.sparkSession
    packed = spark.createDataFrame(parts.mapPartitions(totals), "keys binary, sums binary", verifySchema=False)
    return packed.mapInArrow(rows_of, f"`{key}` {df.schema[key].dataType.simpleString()}, `{output}` array<double>")
