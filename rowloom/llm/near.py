"""Near-duplicate groups by SuperMinHash, banding, verification on full shingle sets and union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import ROW_ID, Scratch, each_text, identified
from rowloom.llm.wordblocks import STEP, mix, odd, shingle_sets

SHINGLE = 5
#: Similarity in percent: linked from here on.
PERCENT = 75
#: At the threshold a link has no common band with probability (1 - 0.75^4)^40, under one in a million.
BANDS, ROWS = 40, 4
#: Bits of a set's parity sketch.
PARITY = 2048
#: Rows of a bucket that are compared with one another at a time.
BLOCK_ROWS = 128
#: Up to this many 8-byte keys are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def super_minhash(elements: np.ndarray, owner: np.ndarray, sets: int, size: int) -> np.ndarray:
    """Signatures (sets x size) of sets given as flat distinct elements with their set's number.

    Each element shuffles the places 0..size-1 and gives the j-th one the rank j plus a fraction, so its values are
    correlated and every place gets one; a place keeps its smallest value. Step j adds ranks of at least j, so a set
    whose places are all below j is done.
    """
    best = np.full(sets * size, np.inf)
    state = mix(elements + STEP)
    place = (mix(state) % np.uint64(size)).astype(np.int64)
    np.minimum.at(best, owner * size + place, (state >> np.uint64(11)) * 2.0 ** -53)
    table = best.reshape(sets, size)
    shuffled = rows = None
    for j in range(1, size):
        more = (table.max(axis=1) > j)[owner]
        if not more.any():
            break
        if shuffled is None:
            elements, owner, place = elements[more], owner[more], place[more]
            rows = np.arange(len(owner))
            shuffled = np.tile(np.arange(size, dtype=np.uint16), (len(owner), 1))
            shuffled[rows, place] = 0
        elif not more.all():
            elements, owner, shuffled = elements[more], owner[more], shuffled[more]
            rows = np.arange(len(owner))
        state = mix(elements + STEP * np.full(1, j + 1, np.uint64))
        drawn = j + (mix(state) % np.uint64(size - j)).astype(np.int64)
        place = shuffled[rows, drawn].astype(np.int64)
        shuffled[rows, drawn] = shuffled[:, j]
        np.minimum.at(best, owner * size + place, j + (state >> np.uint64(11)) * 2.0 ** -53)
    return table


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; sets without elements are not for here."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), 1))
    for r in range(rows):
        key = mix(key * odd(7) + bits[:, :, r])
    return key.view(np.int64)


def signed(docs: DataFrame, key: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """Rows (doc, n_shingles, digest, bands): the digest names the full set; empty sets and null keys have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, ends in shingle_sets(each_text(batch.column(1)), shingle):
                sizes = np.diff(ends)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                table = super_minhash(flat, owner, len(sizes), bands * rows)
                keys = band_keys(table, bands, rows)
                ids = batch.column(0).slice(first, len(sizes))
                void = (sizes == 0) | np.asarray(ids.is_null())
                digests = [None if v else sha256(flat[a:b].tobytes()).digest() for v, a, b in zip(void, ends, ends[1:])]
                lists = [None if v else k for v, k in zip(void, keys)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    ["doc", "n_shingles", "digest", "bands"],
                )

    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(
        run, "doc long, n_shingles long, digest binary, bands array<long>"
    )


def parity(flat: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """For each set, which of PARITY buckets hold an odd number of its shingles, as longs."""
    place = (mix(flat + STEP) % np.uint64(PARITY)).astype(np.int64)
    counts = np.bincount(owner * PARITY + place, minlength=sets * PARITY).reshape(sets, PARITY)
    return np.packbits((counts & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def full_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Rows (doc, shingles, parity): the sorted shingle hashes as bytes, and their parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, ends in shingle_sets(each_text(batch.column(1)), shingle):
                sets = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                bits = [p.tobytes() for p in parity(flat, np.repeat(np.arange(len(sets)), np.diff(ends)), len(sets))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array(sets, pa.binary()), pa.array(bits, pa.binary())],
                    ["doc", "shingles", "parity"],
                )

    return docs.select("doc", text).mapInArrow(run, "doc long, shingles binary, parity binary")


def unlisted(column: pa.ListArray) -> Callable[[int], tuple[np.ndarray, ...]]:
    """Access to the lists of (rep, group, n_shingles, parity) as arrays, one list at a time and without Python rows."""
    rep, group, n, bits = column.flatten().flatten()
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    numbers = [c.to_numpy() for c in (rep, group, n)]

    def side(row: int) -> tuple[np.ndarray, ...]:
        a, b = ends[row], ends[row + 1]
        parity = np.frombuffer(b"".join(bits.slice(a, b - a).to_pylist()), np.uint64).reshape(b - a, -1)
        return (*[c[a:b] for c in numbers], parity)

    return side


def possible(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (band, n, rep, group, n_shingles, parity) that share a band, are in different groups, and may
    be a link.

    Each differing bit of two parity sketches is a differing shingle, and each set has at least its share of the other's
    size, so no link is lost. A bucket is cut into blocks by key hash; block meets block, and only what may be a link
    leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            one, two = (batch.column(i).to_numpy() for i in (0, 1))
            sides = [unlisted(batch.column(i)) for i in (2, 3)]
            for row in range(len(one)):
                (rep_a, group_a, n_a, bits_a), (rep_b, group_b, n_b, bits_b) = (side(row) for side in sides)
                for i in range(len(rep_a)):
                    near = (group_b != group_a[i]) & (100 * np.minimum(n_b, n_a[i]) >= percent * np.maximum(n_b, n_a[i]))
                    if one[row] == two[row]:
                        near &= rep_b < rep_a[i]
                    at = np.flatnonzero(near)
                    differ = np.bitwise_count(bits_b[at] ^ bits_a[i]).sum(1, dtype=np.int64)
                    at = at[differ * (100 + percent) <= (n_b[at] + n_a[i]) * (100 - percent)]
                    if at.size:
                        found.append(np.stack([np.maximum(rep_b[at], rep_a[i]), np.minimum(rep_b[at], rep_a[i])], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    blocks = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int"))
    blocks = blocks.groupBy("band", "block").agg(F.collect_list(F.struct("rep", "group", "n_shingles", "parity")).alias("side"))
    left, right = (blocks.select("band", F.col("block").alias(f"block_{s}"), F.col("side").alias(f"side_{s}")) for s in "ab")
    met = left.join(right, "band").filter("block_a <= block_b").select("block_a", "block_b", "side_a", "side_b")
    return met.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, linked) of pairs (a, b) with full sets: intersection against union, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right")), "b")
    both = left.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, linked boolean")


def forest(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: rows (child, root) with child > root that connect what the edges connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        found = [(x, find(x)) for x in list(parent)]
        found = [p for p in found if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["child", "root"])

    return edges.mapInArrow(run, "child long, root long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (child, root) for every node that is not the smallest of its component.

    Large-star and small-star rounds, with union-find inside the partitions; a hot centre is only joined to the minimum
    of its neighbours, never gathered. Each round is a table in the shared folder.
    """
    stars = scratch.keep(forest(edges), f"{name}0")
    turn, seen = 0, None
    while True:
        both = stars.select(F.col("child").alias("u"), F.col("root").alias("v")).union(stars.select("root", "child"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("child"), F.col("m").alias("root")).distinct()
        small = large.groupBy("child").agg(F.min("root").alias("m"))
        joined = large.join(small, "child")
        turned = joined.select("child", F.col("m").alias("root")).union(joined.filter("root != m").select("root", "m")).distinct()
        turn += 1
        stars = scratch.keep(turned, f"{name}{turn}")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("child", "root").cast("decimal(38,0)"))).first()
        if state == seen:
            return stars
        seen = state


def labelled(rows: DataFrame, node: str, stars: DataFrame, out: str) -> DataFrame:
    named = stars.select(F.col("child").alias(node), F.col("root").alias("_root"))
    return rows.join(named, node, "left").withColumn(out, F.coalesce("_root", node)).drop("_root")


def near_groups(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, percent: int = PERCENT,
                bands: int = BANDS, rows: int = ROWS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: the key, n_shingles, component_id and kept.

    Documents with equal sets are one class from the start. Class representatives share buckets, one per band. Links
    are looked for in three rounds of verified pairs: each representative with the bucket leader that it meets in most
    bands; the other leaders, where the groups still differ; then every pair of a bucket whose groups still differ and
    whose set sizes and parity sketches allow a link. So each such pair is verified or already connected, and large groups
    of near copies cost a pair per row.
    Keys are integers; rows that repeat a key repeat its text. Texts without words, and rows with a null key, are
    linked with nothing; a null key's component is null and the row is kept.
    """
    scratch = Scratch(docs.sparkSession)
    signs = scratch.keep(signed(docs, key, text, shingle, bands, rows), "signed")
    classes = signs.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("rep"))
    members = signs.join(classes, "digest", "left").select(
        "doc", "n_shingles", F.coalesce("rep", "doc").alias("rep"),
        F.when(F.col("doc") == F.col("rep"), F.col("bands")).alias("bands"),
    )
    members = scratch.keep(members, "members")
    scratch.drop("signed")
    slots = members.filter("bands IS NOT NULL").select("rep", F.explode("bands").alias("band"))
    leaders = slots.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last")
    buckets = scratch.keep(slots.join(leaders.drop("last"), "band").distinct(), "buckets")
    needed = scratch.keep(buckets.select("rep").distinct(), "needed")
    few = needed.count() <= broadcast_keys
    wanted = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text")).join(
        F.broadcast(needed) if few else needed, F.col("doc") == needed["rep"], "left_semi"
    )
    sets = scratch.keep(full_sets(wanted, "_text", shingle).dropDuplicates(["doc"]), "sets")

    stars = buckets.filter("rep != leader").groupBy("rep", "leader").agg(F.count("*").alias("votes"))
    stars = scratch.keep(stars, "stars")
    best = stars.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("leader")).alias("l"))).alias("best"))
    first = best.select(F.col("rep").alias("a"), (-F.col("best.l")).alias("b"))
    tested = scratch.keep(verified(first, sets, percent), "tested1")
    groups = components(tested.filter("linked").select("a", "b"), scratch, "first")

    others = stars.select(F.col("rep").alias("a"), F.col("leader").alias("b")).join(tested, ["a", "b"], "left_anti")
    tested = tested.union(scratch.keep(verified(_apart(others, groups), sets, percent), "tested2"))
    groups = components(tested.filter("linked").select("a", "b"), scratch, "second")

    split = labelled(buckets.select("band", "rep"), "rep", groups, "group")
    mixed = split.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n"))
    facts = members.filter("bands IS NOT NULL").select("rep", "n_shingles").dropDuplicates(["rep"])
    facts = facts.join(sets.select(F.col("doc").alias("rep"), "parity"), "rep")
    split = scratch.keep(split.join(mixed.filter("lo < hi").select("band", "n"), "band").join(facts, "rep"), "split")
    across = possible(split, percent).distinct()
    tested = tested.union(scratch.keep(verified(across.join(tested, ["a", "b"], "left_anti"), sets, percent), "tested3"))
    groups = components(tested.filter("linked").select("a", "b"), scratch, "third")

    out = labelled(members.drop("bands"), "rep", groups, "component_id")
    return out.select(
        F.col("doc").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    named = labelled(labelled(pairs, "a", groups, "_ga"), "b", groups, "_gb")
    return named.filter("_ga != _gb").select("a", "b")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one document of each group, with all their columns.

    Rows are judged by key and text: different texts of one key, or without a key, are documents of their own, after smaller
    keys. Rows that repeat both stay or go together.
    """
    ids = identified(docs, key, text, Scratch(docs.sparkSession))
    gone = near_groups(ids.rows, ROW_ID, text).filter("NOT kept").select(ROW_ID)
    return ids.rows.join(gone, ROW_ID, "left_anti").select(*docs.columns)
