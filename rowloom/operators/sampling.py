"""Splits, subsamples, distinct rows and batches, all driven by key hashes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.hashing import HASH_RANGE, hash32, split_name

MAX_TRAIN_ROWS = 20_000  # fixed value: train rows kept for kNN and k-means
ROWS_PER_BUCKET = 65_536


def with_split(df: DataFrame, key: str, seed: int | None = None, exact: bool = False) -> DataFrame:
    """Add ``split``. By default a projection; ``exact`` cuts at exact counts (10% test, then 10% validation,
    both rounded up) of the rows in hash order. Rows of one key stay together."""
    parts = [key] if seed is None else [F.lit(seed), key]
    if not exact:
        return df.withColumn("split", split_name(*parts))

    def ranks(n: int) -> list[int]:
        n_test = math.ceil(0.1 * n)
        return [n_test, n_test + math.ceil(0.1 * (n - n_test))]

    hashed = df.withColumn("_h", F.coalesce(hash32(*parts), F.lit(0)))  # rows without a key come first
    test, validation = (_upto(key, cut) for cut in _cuts(hashed, key, ranks))
    return hashed.withColumn("split", F.when(test, "test").when(validation, "validation").otherwise("train")).drop("_h")


def _upto(key: str, cut: tuple | None) -> Column:
    """Rows not after the cut (hash, key) in the order of (hash, key, null first); none without a cut."""
    if cut is None:
        return F.lit(False)
    h, value = cut
    same = F.col(key).isNull() if value is None else F.col(key).isNull() | (F.col(key) <= F.lit(value))
    return (F.col("_h") < h) | ((F.col("_h") == h) & same)


def _place(counts: list[tuple], rank: int) -> tuple:
    """The value that holds the row of a rank, and the rank inside it, given (value, rows) in order."""
    for value, rows in counts:
        if rank <= rows:
            return value, rank
        rank -= rows
    raise ValueError("rank beyond the table")


def _cuts(hashed: DataFrame, key: str, ranks: Callable[[int], list[int]], direct: int = ROWS_PER_BUCKET) -> list[tuple | None]:
    """(hash, key) of the rows at the ranks that ``ranks`` names for the table's size; None for rank 0.

    All ranks are narrowed in one descent: rows per upper half of the hash, then per whole hash in the ranges that hold
    a rank, then per key of those hashes. Ranges of no more than ``direct`` rows skip the second step. What reaches the
    driver is counts: 65,536 for the first step, as many per rank for the second, and the distinct keys of one hash value
    per rank (or of one small range) for the third. A repeated key is one count however many rows it has.
    """
    upper = F.shiftright("_h", 16)
    counts = sorted(tuple(r) for r in hashed.groupBy(upper).count().collect())
    wanted = ranks(sum(rows for _, rows in counts))
    places = {rank: _place(counts, rank) for rank in wanted if rank}
    if not places:
        return [None] * len(wanted)
    sizes, held = dict(counts), sorted({value for value, _ in places.values()})
    inside = hashed.filter(upper.isin(held))
    if max(sizes[value] for value in held) > direct:
        fine = sorted(tuple(r) for r in inside.groupBy("_h").count().collect())
        places = {rank: _place([c for c in fine if c[0] >> 16 == value], rest) for rank, (value, rest) in places.items()}
        inside = hashed.filter(F.col("_h").isin(sorted({value for value, _ in places.values()})))
        within = {rank: (lambda h, value=value: h == value) for rank, (value, _) in places.items()}
    else:
        within = {rank: (lambda h, value=value: h >> 16 == value) for rank, (value, _) in places.items()}
    keys = [((r[0], r[1]), r[2]) for r in inside.groupBy("_h", key).count().collect()]
    keys.sort(key=lambda c: (c[0][0], c[0][1] is not None, c[0][1]))
    found = {rank: _place([c for c in keys if within[rank](c[0][0])], rest)[0] for rank, (_, rest) in places.items()}
    return [found.get(rank) for rank in wanted]


def subsample(df: DataFrame, key: str, rows: int = MAX_TRAIN_ROWS, seed: int = 0) -> DataFrame:
    """The ``rows`` rows with the least key hash; all rows where the table is no larger.

    The (hash, key) of the last row is found by counts (:func:`_cuts`); the sample is a filter, so it stays spread. Rows
    of one key stay together, so a repeated key at the cut adds its other rows.
    """
    hashed = df.withColumn("_h", hash32(F.lit(seed), key))
    (cut,) = _cuts(hashed, key, lambda n: [rows if n > rows else 0])
    return df if cut is None and rows > 0 else hashed.filter(_upto(key, cut)).drop("_h")


def subsample_sql(relation: str, key: str, rows: int = MAX_TRAIN_ROWS, seed: int = 0) -> str:
    from rowloom.functions.hashing import hash32_sql

    return f"(SELECT * FROM {relation} ORDER BY {hash32_sql(str(seed), key)}, {key} LIMIT {rows})"


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def assign_batches(df: DataFrame, key: str, batch_size: int, epoch: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``batch_id`` and ``pos``: rows in hash order of (key, epoch), cut into batches of ``batch_size``.

    Batches have no gaps: only the last one of an epoch may be short. Rows fall into equal hash ranges of about
    ``rows_per_bucket`` rows and are ranked inside their range; the rows of all earlier ranges come from prefix sums in two
    levels (:func:`range_starts`), so no task holds more than one range. The key tells rows apart.
    """
    hashed = df.withColumn("_h", hash32(F.lit(epoch), key))
    buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    width = math.ceil(HASH_RANGE / buckets)
    ranged = hashed.withColumn("_bucket", F.floor(F.col("_h") / width))
    row = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key)) - 1
    return (
        ranged.join(range_starts(ranged.groupBy("_bucket").count()), "_bucket")
        .withColumn("_row", F.col("_start") + row)
        .withColumn("batch_id", F.floor(F.col("_row") / batch_size))
        .withColumn("pos", (F.col("_row") % batch_size).cast("int"))
        .select(*[F.col(f"`{c}`") for c in df.columns], "batch_id", "pos")
    )


def range_starts(counts: DataFrame, group: int = 1024) -> DataFrame:
    """``_start``, the rows of all earlier ranges, for rows (_bucket, count): sums inside groups of ranges, and over groups."""
    grouped = counts.withColumn("_group", F.floor(F.col("_bucket") / group))

    def earlier(window):
        return F.coalesce(F.sum("count").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = grouped.groupBy("_group").agg(F.sum("count").alias("count"))
    groups = groups.select("_group", earlier(Window.orderBy("_group")).alias("_before"))
    inside = grouped.withColumn("_inside", earlier(Window.partitionBy("_group").orderBy("_bucket")))
    return inside.join(groups, "_group").select("_bucket", (F.col("_before") + F.col("_inside")).alias("_start"))


def assign_batches_sql(relation: str, key: str, batch_size: int, epoch: int = 0) -> str:
    """The same batches as SQL text: one global row number."""
    from rowloom.functions.hashing import hash32_sql

    return f"""(
      WITH ranked AS (
        SELECT *, row_number() OVER (ORDER BY {hash32_sql(str(epoch), key)}, {key}) - 1 AS _row FROM {relation})
      SELECT * EXCLUDE (_row), _row // {batch_size} AS batch_id, CAST(_row % {batch_size} AS INTEGER) AS pos
      FROM ranked)"""


def cached(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def compact(df: DataFrame, rows_per_partition: int = 4096) -> DataFrame:
    """Materialise ``df`` and merge partitions that hold far fewer rows than a task is worth, without a shuffle."""
    kept = cached(df)
    wanted = max(1, math.ceil(kept.count() / rows_per_partition))
    if kept.rdd.getNumPartitions() <= wanted:
        return kept
    return cached(kept.coalesce(wanted))
