"""Exact deduplication over an extendible-hash index on shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import BLANKS, Scratch, digest

#: Distinct keys in a full bucket.
CAPACITY = 4096
#: Up to this many 8-byte keys are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Up to this many keys with digests are.
BROADCAST_ROWS = 100_000


def normal(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def prefix(key: Column | str, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(slots: DataFrame, distinct_keys: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows (local_depth, bucket), the buckets of an extendible-hash directory over a column ``key``.

    The directory starts at the depth that distinct keys fill by half at least, and doubles while a bucket holds more
    than ``capacity`` distinct keys; only overfull buckets are split. Copies of a key chain in one slot, so a hot key
    fills no bucket. Two keys split at depth 64 at the latest.
    """
    depth = max(0, (distinct_keys // capacity).bit_length() - 1)
    level = slots.groupBy(prefix("key", depth).alias("bucket")).agg(F.count("*").alias("n"))
    done = level.filter(F.col("n") <= capacity).select(F.lit(depth).alias("local_depth"), "bucket")
    open_buckets = level.filter(F.col("n") > capacity).select("bucket")
    while depth < 64 and not open_buckets.isEmpty():
        parents = open_buckets.withColumnRenamed("bucket", "parent")
        split = slots.withColumn("parent", prefix("key", depth)).join(parents, "parent", "left_semi")
        depth += 1
        level = split.groupBy(prefix("key", depth).alias("bucket")).agg(F.count("*").alias("n"))
        done = done.union(level.filter(F.col("n") <= capacity).select(F.lit(depth).alias("local_depth"), "bucket"))
        open_buckets = level.filter(F.col("n") > capacity).select("bucket")
    return done


def build_index(keys: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """The index on shared files: rows (local_depth, bucket, key, n_rows), a slot per distinct key.

    Files hold key ranges in order, so each is written by the one task that owns the range.
    """
    slots = scratch.keep(keys.groupBy("key").agg(F.count("*").alias("n_rows")), "slots")
    found = scratch.keep(directory(slots, slots.count(), capacity), "directory")
    depths = [r[0] for r in found.select("local_depth").distinct().collect()]  # at most 65
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("local_depth"), prefix("key", d).alias("bucket")) for d in depths])) if depths else None
    if at is None:
        return slots.select(F.lit(0).alias("local_depth"), F.lit(0).cast("long").alias("bucket"), "key", "n_rows")
    owned = slots.withColumn("_at", at).select("key", "n_rows", "_at.*").join(found, ["local_depth", "bucket"])
    ranged = owned.repartitionByRange("key").sortWithinPartitions("key")
    return scratch.keep(ranged.select("local_depth", "bucket", "key", "n_rows"), "index")


def marked(docs: DataFrame, key: str, text: str, scratch: Scratch, capacity: int = CAPACITY, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: _id, raw (digest of the text as it is), sha (of the normalised text), keep_id, keep_raw and
    group_size.

    Texts are equal when they are identical without white space. Of equal texts the row with the most code points
    stays, then the smallest key (null last). A slot of the index with one row is settled; for the others the
    normalised texts are read again and compared as bytes: they are grouped by (key, text) after partial aggregation,
    so a hot text leaves one row per task, and texts that collide in a slot form a chain of groups. Of rows with equal
    keys and as many code points the text with the greatest digest stays.
    """
    whole = docs.select(
        F.col(key).alias("_id"), normal(F.col(text)).alias("norm"), digest(text).alias("raw"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"),
    ).withColumn("key", F.xxhash64("norm"))
    keys = scratch.keep(whole.select("_id", "key", "raw", F.unhex(F.sha2("norm", 256)).alias("sha")), "keys")
    index = build_index(keys, scratch, capacity)
    shared = scratch.keep(index.filter("n_rows > 1").select("key"), "shared_keys")
    small = shared.count() <= broadcast_keys
    repeated = whole.join(F.broadcast(shared) if small else shared, "key", "left_semi")
    best = F.max(F.struct("n_chars", F.col("_id").isNotNull().alias("named"), (-F.col("_id")).alias("negated"), "raw"))
    chains = repeated.groupBy("key", "norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    chains = scratch.keep(
        chains.select(
            "key", F.unhex(F.sha2("norm", 256)).alias("sha"), (-F.col("best.negated")).alias("keep_id"), F.col("best.raw").alias("keep_raw"), "group_size"
        ),
        "chains",
    )
    alone = keys.join(shared, "key", "left_anti").select(
        "_id", "raw", "sha", F.col("_id").alias("keep_id"), F.col("raw").alias("keep_raw"), F.lit(1).cast("long").alias("group_size")
    )
    return alone.union(keys.join(chains, ["key", "sha"]).select("_id", "raw", "sha", "keep_id", "keep_raw", "group_size"))


def duplicates(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: the key, keep_id, group_size, kept and text_sha256 (of the normalised text).

    Repeated rows with equal keys are one group whose size counts them all; all of them are marked kept if that key stays.
    """
    return marked(docs, key, text, Scratch(docs.sparkSession), capacity, broadcast_keys).select(
        F.col("_id").alias(key), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of texts that are equal without white space, one.

    Rows are told apart by key and text. Where the row that stays is there more than once, with the same key (or none) and
    the same text, the least of those rows stays.
    """
    scratch = Scratch(docs.sparkSession)
    stays = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw"))
    rows = marked(docs, key, text, scratch).filter("group_size > 1").groupBy(F.col("_id").alias("_dropped"), F.col("raw").alias("_raw"))
    rows = rows.agg(F.max(stays).alias("_stays"), F.count("*").alias("_n")).filter("NOT _stays OR _n > 1")
    rows = scratch.keep(rows, "verdicts")
    here = docs[key].eqNullSafe(F.col("_dropped")) & (digest(docs[text]) == F.col("_raw"))
    several = rows.filter("_stays")
    n = several.count()
    if not n:
        return docs.join(rows, here, "left_anti")
    # sent to every task, if few, so that a hot row is reduced to one per task before it is shuffled
    again = docs.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, here).groupBy("_dropped", "_raw").agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("_row"))
    return docs.join(rows, here, "left_anti").union(again.select("_row.*"))
