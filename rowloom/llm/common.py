"""Shared pieces: scratch tables in the shared folder, word patterns, hash order and distributed running totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions.hashing import hash32
from rowloom.session import ensure_checkpoint_dir

#: White space of the contracts: space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
ROWS_PER_BUCKET = 20_000


class Scratch:
    """Tables in the shared folder that cut lineage: what is written survives lost executors and is read again from there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
        self.folder = f"{root}/rowloom-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete one of this object's own tables, when nothing reads it any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text, without the empty pieces at its ends; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def each_text(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts of a batch's column, a few rows at a time, so that a task does not hold a batch twice."""
    for first in range(0, len(column), rows):
        yield from column.slice(first, rows).to_pylist()


def bucket_count(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(64, rows // per_bucket)


def hash_bucket(hash_column: str, buckets: int) -> Column:
    """Equal ranges of a 32-bit hash, so that order by (bucket, hash) is order by hash."""
    return F.shiftright(F.col(hash_column) * F.lit(buckets), 32)


def key_hash(key: str) -> Column:
    """32-bit hash of a record key; a null key hashes like an empty one."""
    return hash32(F.coalesce(F.col(key).cast("string"), F.lit("")))


def digest(text: Column | str) -> Column:
    """SHA-256 of a text as it is; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def running_totals(df: DataFrame, keys: list[str], bucket: str, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Totals of earlier rows, as ``{output: value column}``, in the order of (bucket, order) inside each key.

    Two levels: sums per (key, bucket), then offsets over the buckets, then a window inside each bucket. No task
    holds a whole key.
    """
    place = [*keys, bucket]
    sums = df.groupBy(*place).agg(*[F.sum(v).alias(f"_sum_{out}") for out, v in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *place, *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in totals]
    )
    inside = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, place)
    for name, value in totals.items():
        out = out.withColumn(name, F.col(f"_before_{name}") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop(*[f"_before_{name}" for name in totals])


#: The column that :func:`identified` adds.
ROW_ID = "_rowloom_id"
#: Tables of fewer rows than this are sent to every task.
FEW_ROWS = 100_000


@dataclass(frozen=True)
class RowIds:
    """Documents with a long per (key, text) in the order of their keys: ``rows`` has it as ``ROW_ID``."""

    rows: DataFrame
    bits: int
    first_null: int

    def key(self, row_id: str, kind) -> Column:
        """The key that an id stands for; null for rows without one."""
        return F.when(F.col(row_id) < self.first_null, F.shiftright(F.col(row_id), self.bits)).cast(kind)


def identified(docs: DataFrame, key: str, text: str, scratch: Scratch) -> RowIds:
    """Tell rows apart that share a key, or have none, but differ in text (by 128 bits of hash).

    Where every key has one text the id is the key, and rows without a key share the largest long. Otherwise keys move
    up by a few bits, texts of one key are numbered in the order of a hash, and rows without a key come after all
    others. Only such keys are numbered, in two levels, so that no task holds all texts of a hot key; nothing is joined to
    the documents where there are none. Raises where keys are too large to move.
    """
    number = F.col(key).cast("long")
    hashes = {"_h1": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "_h2": F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1))}
    parts = {"_none": number.isNull(), "_key": F.coalesce(number, F.lit(0).cast("long")), **hashes}
    base = docs.select(*[c.alias(n) for n, c in parts.items()])
    seen = base.groupBy("_none", "_key").agg(
        ((F.min("_h1") < F.max("_h1")) | (F.min("_h2") < F.max("_h2"))).alias("several")
    )
    seen = scratch.keep(seen, "keys_seen")
    odd = seen.filter("several").select("_none", "_key")
    count, top, low = odd.count(), *seen.filter("NOT _none").agg(F.max("_key"), F.min("_key")).first()
    last = (1 << 63) - 1
    if not count:
        scratch.drop("keys_seen")
        return RowIds(docs.withColumn(ROW_ID, F.coalesce(number, F.lit(last))), 0, last)
    pairs = base.join(F.broadcast(odd) if count <= FEW_ROWS else odd, ["_none", "_key"]).distinct()
    pairs = scratch.keep(pairs.withColumn("_bucket", F.shiftright("_h1", 52)).withColumn("_one", F.lit(1)), "key_texts")
    order = [F.col("_h1"), F.col("_h2")]
    ranks = running_totals(pairs, ["_none", "_key"], "_bucket", order, {"_sub": "_one"}).drop("_bucket", "_one")
    ranks = scratch.keep(ranks, "key_ranks")
    most = ranks.filter("NOT _none").agg(F.max("_sub")).first()[0] or 0
    bits = int(most).bit_length()
    top, low = top if top is not None else 0, low if low is not None else 0
    if max(abs(top), abs(low)) + 2 >= 1 << (61 - bits):
        raise ValueError(f"keys up to {max(abs(top), abs(low))} are too large to number {most + 1} texts of one key")
    first_null = (top + 1) << bits
    few = ranks.count() <= FEW_ROWS
    named = docs.withColumns({f"{n}_of": c for n, c in parts.items()})
    ranks = ranks.select(*[F.col(n).alias(f"{n}_of") for n in parts], "_sub")
    found = named.join(F.broadcast(ranks) if few else ranks, [f"{n}_of" for n in parts], "left")
    sub = F.coalesce(F.col("_sub").cast("long"), F.lit(0).cast("long"))
    moved = F.when(F.col("_none_of"), F.lit(first_null) + sub).otherwise(F.shiftleft(F.col("_key_of"), bits) + sub)
    return RowIds(found.select(*[F.col(f"`{c}`") for c in docs.columns], moved.alias(ROW_ID)), bits, first_null)
