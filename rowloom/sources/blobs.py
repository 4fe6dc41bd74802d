"""The XOR-blobs table: four Gaussian blobs whose class needs both axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.columns import union_named
from rowloom.operators.scaling import scaled

# Centres in index order, spread, and rows per split.
CENTRES = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))
SPREAD = 0.25
SPLIT_ROWS = {"train": 1000, "validation": 100, "test": 100}


def xor_blobs(spark: SparkSession, rows: dict[str, int] = SPLIT_ROWS, seed: int = 0) -> DataFrame:
    """(row_id, c, x, y, split): class = centre index mod 2; each axis scaled to [0, 1] within its split."""
    parts, offset = {}, 0
    for i, (split, n) in enumerate(rows.items()):
        corner = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in CENTRES])[(F.col("row_id") % 4).cast("int")]
        parts[split] = spark.range(offset, offset + n, numPartitions=max(1, n // 1_000_000)).withColumnRenamed("id", "row_id").select(
            "row_id", (F.col("row_id") % 2).cast("int").alias("c"),
            (corner[0] + SPREAD * F.randn(seed + 10 * i)).alias("x"), (corner[1] + SPREAD * F.randn(seed + 10 * i + 5)).alias("y"),
        )
        offset += n
    df = union_named(parts, "split")
    ranges = df.groupBy("split").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])
    joined = df.join(F.broadcast(ranges), "split")  # one row per split
    return joined.select(
        "row_id", "c", *[scaled(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")).alias(c) for c in ("x", "y")], "split"
    )
