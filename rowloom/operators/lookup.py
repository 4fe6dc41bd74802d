"""Join of a large table with a keyed table: broadcast below a measured size, beyond it a shuffle join salted by share."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

MAX_BROADCAST_BYTES = 64 << 20
#: A key with more than this share of the rows gets one salt per share of this size.
HOT_SHARE = 1 / 256
#: Keys that the sketch reports, and those that it tracks: its counts are at most 3.5 / TRACKED of the rows off.
REPORTED = 256
TRACKED = 8192
ROW_BYTES = 32  # what a row takes in a hash table besides its values


def _value_bytes(column: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, StringType | BinaryType | ArrayType):
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * 8 + 32
    if kind.simpleString().startswith(("array", "struct", "map")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 2 + 32
    return F.lit(16)


def table_bytes(table: DataFrame) -> int:
    """Size of a table as rows of a hash table, from one pass over it."""
    widths = [_value_bytes(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in table.schema]
    return table.agg(F.sum(sum(widths, F.lit(ROW_BYTES)))).first()[0] or 0


def hot_keys(df: DataFrame, on: list[str], hot_share: float = HOT_SHARE) -> dict[int, int]:
    """Salts of the keys that hold more than ``hot_share`` of the rows, by key hash.

    A sketch of frequent items is merged over all tasks, so what is collected does not grow with the data. Rows without a
    key meet nothing and need no salt here.
    """
    keyed = df.dropna(subset=on).select(F.xxhash64(*on).alias("_h"))
    found = keyed.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {REPORTED}, {TRACKED})").alias("top")).first()
    per_salt = max(1.0, found["n"] * hot_share)
    return {r["item"]: math.ceil(r["count"] / per_salt) for r in found["top"] if r["count"] > per_salt}


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    size: int | None = None,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Add the columns of ``table`` (unique on ``on``) to ``df``; null keys find nothing.

    The size of ``table`` in bytes decides (it is measured where the caller does not know it). Up to the bound it is
    broadcast. Beyond it both sides are shuffled by key: a sketch finds the keys that hold much of ``df``, their table rows are
    repeated once per salt, and their ``df`` rows draw a salt from their own content. All other keys have one salt. Rows
    of ``df`` without a key are spread by content too.
    """
    if (table_bytes(table) if size is None else size) <= max_broadcast_bytes:
        return df.join(F.broadcast(table), on, how)
    salts = hot_keys(df, on, hot_share)
    listed = F.from_json(F.lit(json.dumps({str(h): n for h, n in salts.items()})), "map<string,int>")
    of_key = F.coalesce(F.try_element_at(listed, F.xxhash64(*on).cast("string")), F.lit(1))
    missing = sum((F.col(c).isNull().cast("int") for c in on), F.lit(0)) > 0
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    salted = df.withColumn("_salt", F.when(missing, content).otherwise(F.pmod(content, of_key.cast("long"))))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), of_key.cast("long") - 1)))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
