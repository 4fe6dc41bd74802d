"""Removal of repeated word windows, found by recompression: names for runs and pairs that depend on content alone."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import ROW_ID, Scratch, identified
from rowloom.llm.wordblocks import STEP, blocks, mix, odd, windows

WINDOW = 20
#: Rounds of pairs; a symbol of the last one covers about seven words.
ROUNDS = 7
#: Bytes of text in a chunk of documents, and of text whose symbols meet in one bucket.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Symbols that a task gathers before it sends them on.
FLUSH = 2_000_000
#: Up to this many 8-byte keys are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
LAST = (1 << 63) - 1
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
LOW = np.uint64((1 << 40) - 1)
_LEFT, _RIGHT, _LONG = odd(11), odd(12), odd(13)
RECORD = np.dtype([("key", "<u8"), ("check", "<u2"), ("doc", "<i8"), ("start", "<i4")])
PLACE = np.dtype([("doc", "<i8"), ("start", "<i4")])


def rounds(hashes: np.ndarray, owner: np.ndarray, count: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, first, last) after the run round and each pair round.

    A run of equal words gets a name from the word and its length. Then each round puts every symbol on the left or the
    right side by its name, and each left symbol followed by a right one becomes their pair, named after both. Names and
    sides depend on content alone, so equal words have equal symbols, but for those at the ends that what stands outside
    can change: for each word, ``first`` is the first symbol that whatever stands before the word leaves alone, and
    ``last`` the last that whatever follows leaves alone.
    """
    n = len(hashes)
    begins = np.ones(n, bool)
    begins[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    run = np.cumsum(begins) - 1
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, n)).astype(np.uint64)
    symbols, owner = hashes[at].copy(), owner[at]
    long = length > 1
    symbols[long] = mix(symbols[long] * _LEFT + length[long] * _LONG)
    first, last = run + 1, run - 1
    yield symbols, first, last
    for turn in range(1, count + 1):
        size = len(symbols)
        on_right = (mix(symbols + STEP * np.array([turn], np.uint64)) & np.uint64(1)).astype(bool)
        joins = np.zeros(size + 1, bool)
        joins[1:size] = ~on_right[:-1] & on_right[1:] & (owner[:-1] == owner[1:])
        kept = np.flatnonzero(~joins[:size])
        place = np.append(np.cumsum(~joins[:size]) - 1, len(kept))
        named = symbols[kept].copy()
        pair = joins[kept + 1]
        named[pair] = mix(named[pair] * _LEFT + symbols[kept[pair] + 1] * _RIGHT + np.uint64(turn))
        # an outer left symbol could take a first right one, and a last left one an outer right symbol
        inner = np.minimum(first, size - 1)
        first = np.where(first >= size, len(kept), np.where(on_right[inner], place[inner + 1], place[inner]))
        inner = np.maximum(last, 0)
        before = np.where(inner > 0, place[inner - 1], -1)
        last = np.where(last < 0, -1, np.where(on_right[inner], place[inner], before))
        symbols, owner = named, owner[kept]
        yield symbols, first, last


def anchors(hashes: np.ndarray, owner: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, places) of windows: a window's anchor is its first inner symbol of the highest round that has one, and
    the place tells which symbol of this text it is. Equal windows have equal anchors, and neighbouring ones mostly
    share the place of theirs. A window of one or two runs is its own anchor."""
    out = mix(windows(hashes, window)[starts] + STEP)
    place = -1 - starts
    for turn, (symbols, first, last) in enumerate(rounds(hashes, owner)):
        a, b = first[starts], last[starts + window - 1]
        inner = a <= b
        out[inner] = mix(symbols[a[inner]] + np.full(1, turn, np.uint64) * _LONG)
        place[inner] = a[inner] * (ROUNDS + 1) + turn
    return out, place


def window_starts(ends: np.ndarray, window: int) -> np.ndarray:
    sizes = np.diff(ends)
    return np.concatenate([np.arange(a, a + max(0, s - window + 1)) for a, s in zip(ends, sizes)] or [np.zeros(0, int)]).astype(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """Five bytes for each 40-bit number."""
    return np.ascontiguousarray(low.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def unpacked(blob: bytes) -> np.ndarray:
    five = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel()


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def cuts(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), len(keys[0]))


def batch_of(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], list(schema))


ANCHOR_ROWS = {"bucket": pa.int32(), "chunk": pa.int32(), "blob": pa.binary()}


def anchor_rows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows (bucket, chunk, blob): the anchors of the chunk's documents that a task has seen, each once, or twice if it
    stands at several places."""

    def flush(found: list[np.ndarray], chunks: list[np.ndarray]) -> pa.RecordBatch:
        anchor, chunk = np.concatenate(found), np.concatenate(chunks)
        bucket, low = bucket_of(anchor, buckets), anchor & LOW
        order = np.lexsort((low, chunk, bucket))
        bucket, chunk, low = bucket[order], chunk[order], low[order]
        third = np.zeros(len(low), bool)
        third[2:] = (low[2:] == low[:-2]) & (chunk[2:] == chunk[:-2]) & (bucket[2:] == bucket[:-2])
        bucket, chunk, low = bucket[~third], chunk[~third], low[~third]
        bounds, five = cuts(bucket, chunk), packed(low)
        return batch_of(ANCHOR_ROWS, [(bucket[a], chunk[a], five[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, chunks, size = [], [], 0
        for batch in batches:
            chunk_of = batch.column(1).to_numpy()
            for first, n, hashes, ends in blocks(batch.column(2).to_pylist(), lower=False):
                starts = window_starts(ends, window)
                if not len(starts):
                    continue
                owner = np.repeat(np.arange(n), np.diff(ends))
                anchor, place = anchors(hashes, owner, starts, window)
                new = np.unique(place, return_index=True)[1]
                found.append(anchor[new])
                chunks.append(chunk_of[first + owner[starts[new]]])
                size += len(new)
                if size > FLUSH:
                    yield flush(found, chunks)
                    found, chunks, size = [], [], 0
        if size:
            yield flush(found, chunks)

    return docs.mapInArrow(run, "bucket int, chunk int, blob binary")


def repeated_rows(rows: DataFrame) -> DataFrame:
    """Rows (chunk, bucket, blob): of each chunk's anchors those that stand at more than one place anywhere."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        low = np.concatenate([unpacked(b) for b in blobs])
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(b) // 5 for b in blobs])
        order = np.lexsort((chunk, low))
        low, chunk = low[order], chunk[order]
        bounds = cuts(low)
        often = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        low, chunk = low[often], chunk[often]
        once = cuts(low, chunk)[:-1] if len(low) else np.zeros(0, int)
        low, chunk = low[once], chunk[once]
        order = np.lexsort((low, chunk))
        low, chunk = low[order], chunk[order]
        bounds = cuts(chunk) if len(low) else np.zeros(1, int)
        five, bucket = packed(low), table.column("bucket")[0].as_py()
        found = [(chunk[a], bucket, five[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
        return pa.Table.from_batches([batch_of({"chunk": pa.int32(), "bucket": pa.int32(), "blob": pa.binary()}, found)])

    return rows.groupBy("bucket").applyInArrow(run, "chunk int, bucket int, blob binary")


PART_ROWS = {
    "bucket": pa.int32(), "chunk": pa.int32(), "kind": pa.int32(), "blob": pa.binary(),
    "doc": pa.int64(), "n_words": pa.int64(), "whole": pa.binary(),
}
PART_SCHEMA = "bucket int, chunk int, kind int, blob binary, doc long, n_words long, whole binary"
DOCUMENT, CANDIDATES, REPEATS = 0, 1, 2


def joined_words(text: str | None) -> list[str]:
    return [w for w in _BLANKS.split(text or "") if w]


def digest(words: list[str]) -> bytes:
    return sha256(" ".join(words).encode()).digest()


def candidate_rows(docs: DataFrame, repeated: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows of three kinds: each document with its word count and whole digest; the windows whose anchor repeats, at
    their first place in the chunk; and their other places in the chunk, which are repeats already."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        marks = [np.uint64(b) << np.uint64(40) | unpacked(blob) for b, blob in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist())]
        known = np.sort(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        texts, ids = left.column("text").to_pylist(), left.column("doc").to_numpy()
        chunk = left.column("chunk")[0].as_py() if len(ids) else 0
        rows, records = [], []
        for i, text in zip(ids, texts):
            words = joined_words(text)
            rows.append((chunk % buckets, chunk, DOCUMENT, None, i, len(words), digest(words)))
        for first, n, hashes, ends in blocks(texts, lower=False) if len(known) else ():
            starts = window_starts(ends, window)
            if not len(starts):
                continue
            owner = np.repeat(np.arange(n), np.diff(ends))
            anchor, _ = anchors(hashes, owner, starts, window)
            code = bucket_of(anchor, buckets).astype(np.uint64) << np.uint64(40) | anchor & LOW
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            starts, anchor = starts[known[at] == code], anchor[known[at] == code]
            out = np.zeros(len(starts), RECORD)
            out["key"] = windows(hashes, window)[starts]
            out["check"] = (windows(hashes * _LONG, window)[starts] >> np.uint64(48)).astype(np.uint16)
            out["doc"] = ids[first + owner[starts]]
            out["start"] = starts - ends[owner[starts]]
            records.append((out, bucket_of(anchor, buckets)))
        if records:
            found, bucket = np.concatenate([r[0] for r in records]), np.concatenate([r[1] for r in records])
            order = np.lexsort((found["start"], found["doc"], found["check"], found["key"], bucket))
            found, bucket = found[order], bucket[order]
            again = np.ones(len(found), bool)
            again[cuts(bucket, found["key"], found["check"])[:-1]] = False
            again[1:] &= (found["doc"][1:] != found["doc"][:-1]) | (found["start"][1:] != found["start"][:-1])
            if again.any():
                rows.append((chunk % buckets, chunk, REPEATS, places(found[again]), None, None, None))
            found, bucket = found[~again], bucket[~again]
            order = np.lexsort((found["start"], found["doc"], bucket))
            found, bucket = found[order], bucket[order]
            bounds = cuts(bucket)
            rows += [(bucket[a], chunk, CANDIDATES, found[a:b].tobytes(), None, None, None) for a, b in zip(bounds, bounds[1:])]
        return pa.Table.from_batches([batch_of(PART_ROWS, rows)])

    return docs.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(run, PART_SCHEMA)


def places(found: np.ndarray) -> bytes:
    out = np.zeros(len(found), PLACE)
    out["doc"], out["start"] = found["doc"], found["start"]
    return np.sort(out, order=["doc", "start"]).tobytes()


def repeat_rows(parts: DataFrame) -> DataFrame:
    """Per bucket the first place of each window over all chunks; the other places go back to their chunks as repeats.
    Rows of the other kinds pass."""

    def run(table: pa.Table) -> pa.Table:
        is_candidate = np.array(table.column("kind").to_numpy() == CANDIDATES)
        passed = table.filter(pa.array(~is_candidate))
        some = table.filter(pa.array(is_candidate))
        if not some.num_rows:
            return passed
        blobs = some.column("blob").to_pylist()
        found = np.frombuffer(b"".join(blobs), RECORD)
        chunk = np.repeat(some.column("chunk").to_numpy(), [len(b) // RECORD.itemsize for b in blobs])
        order = np.lexsort((found["start"], found["doc"], found["check"], found["key"]))
        found, chunk = found[order], chunk[order]
        again = np.ones(len(found), bool)
        again[cuts(found["key"], found["check"])[:-1]] = False
        again[1:] &= (found["doc"][1:] != found["doc"][:-1]) | (found["start"][1:] != found["start"][:-1])
        found, chunk = found[again], chunk[again]
        order = np.argsort(chunk, kind="stable")
        found, chunk = found[order], chunk[order]
        bounds = cuts(chunk) if len(chunk) else np.zeros(1, int)
        rows = [(0, chunk[a], REPEATS, places(found[a:b]), None, None, None) for a, b in zip(bounds, bounds[1:])]
        return pa.Table.from_batches([*passed.to_batches(), batch_of(PART_ROWS, rows)], passed.schema)

    return parts.groupBy("bucket").applyInArrow(run, PART_SCHEMA)


def cleaned_rows(docs: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    """Rows (doc, whole, n_removed, kept, text): documents with repeats without the words that those cover."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.sort(np.frombuffer(b"".join(right.column("blob").to_pylist()), PLACE), order=["doc", "start"])
        rows = []
        for i, text in zip(left.column("doc").to_pylist(), left.column("text").to_pylist()):
            a, b = np.searchsorted(found["doc"], [i, i + 1]) if i < LAST else (np.searchsorted(found["doc"], i), len(found))
            words = joined_words(text)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, found["start"][a:b], 1)
            np.add.at(change, np.minimum(found["start"][a:b] + window, len(words)), -1)
            stays = np.cumsum(change)[:-1] == 0
            kept = [w for w, s in zip(words, stays.tolist()) if s]
            rows.append((i, digest(words), len(words) - len(kept), " ".join(kept)))
        return pa.Table.from_batches([batch_of({"doc": pa.int64(), "whole": pa.binary(), "n_removed": pa.int64(), "text": pa.string()}, rows)])

    return docs.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(run, "doc long, whole binary, n_removed long, text string")


def docs_of(repeats: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(blob, PLACE)["doc"]))], ["doc"])

    return repeats.select("blob").mapInArrow(run, "doc long").distinct()


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES,
                    broadcast_keys: int = BROADCAST_KEYS, digests: bool = False) -> DataFrame:
    """One row per document: the key, n_words, n_removed and the kept words joined by a space (``kept_text``), or, with
    ``digests``, only their SHA-256 (``kept_sha256``).

    A word goes if a window of ``window`` words that covers it starts earlier as well, in a document with a smaller key
    or earlier in the same one. Keys are integers. Rows with the same key and text are one document; different texts of
    one key are documents that follow each other in the order of a hash, and so are texts without a key, which come last.
    Null texts have no words.

    Documents are dealt into chunks by key hash. (1) Each task names runs and pairs and sends every anchor, about one
    for three words, five bytes each. (2) Per bucket of anchors, those that repeat go back to their chunks. (3) Chunks
    hash the windows of repeated anchors; of equal ones in a chunk all but the first are repeats, the first is compared
    over all chunks. (4) Documents with repeats are read once more and lose the covered words. A passage that a third
    of all documents hold is one record per chunk.
    """
    scratch = Scratch(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, buckets = max(64, total // chunk_bytes), max(64, total // bucket_bytes)
    ids = identified(docs.select(F.col(key), F.col(text).alias("_text")), key, "_text", scratch)
    rows = ids.rows.select(F.col(ROW_ID).alias("doc"), F.col("_text").alias("text"))
    rows = rows.select("doc", F.pmod(F.xxhash64("doc"), F.lit(chunks)).cast("int").alias("chunk"), "text")
    repeated = repeated_rows(anchor_rows(rows, window, buckets))
    parts = scratch.keep(repeat_rows(candidate_rows(rows, repeated, window, buckets)).drop("bucket"), "parts")
    repeats = parts.filter(F.col("kind") == REPEATS).select("chunk", "blob")
    changed = scratch.keep(docs_of(repeats), "changed")
    few = changed.count() <= broadcast_keys
    touched = rows.join(F.broadcast(changed) if few else changed, "doc", "left_semi").select("doc", "chunk", "text")
    cleaned = cleaned_rows(touched, repeats, window)
    own = ids.key("doc", docs.schema[key].dataType).alias(key)
    removed = F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed")
    whole = parts.filter(F.col("kind") == DOCUMENT).select("doc", "n_words", "whole")
    if digests:
        cleaned = cleaned.select("doc", "whole", "n_removed", F.unhex(F.sha2("text", 256)).alias("sha")).distinct()
        both = whole.join(cleaned, ["doc", "whole"], "left")
        return both.select(own, "n_words", removed, F.lower(F.hex(F.coalesce("sha", "whole"))).alias("kept_sha256"))
    cleaned = cleaned.select("doc", "n_removed", F.col("text").alias("_kept")).dropDuplicates(["doc"])
    counts = whole.dropDuplicates(["doc"]).select("doc", "n_words")
    both = rows.join(counts, "doc").join(cleaned, "doc", "left")
    plain = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), ""), " ")
    return both.select(own, "n_words", removed, F.coalesce("_kept", plain).alias("kept_text"))
