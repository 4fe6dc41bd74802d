"""Shards by weighted rendezvous hashing of a record key, with gapless places inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import Scratch, bucket_count, hash_bucket, key_hash, running_totals

#: A shard's draw is the first 52 bits of an MD5, which a double holds exactly.
DRAW_BITS = 52


def draw(key: Column, shard: int) -> Column:
    """Uniform number in (0, 1) that depends on the key and the shard alone."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f"|{shard}"))), 1, DRAW_BITS // 4)
    return (F.conv(digest, 16, 10).cast("long").cast("double") + 0.5) / float(1 << DRAW_BITS)


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """Struct (score, shard) of the shard with the highest score -weight / ln(draw); ties go to the lower shard.

    A shard gets keys in proportion to its weight. Adding a shard changes no other shard's score, so keys only move
    into the new one.
    """
    if any(w <= 0 for w in weights):
        raise ValueError("weights are positive")
    scored = [
        F.struct((F.lit(float(w)) / -F.log(draw(key, s))).alias("score"), F.lit(-s).alias("negated"))
        for s, w in enumerate(weights, first)
    ]
    best = F.array_max(F.array(*scored))
    return F.struct(best["score"].alias("score"), (-best["negated"]).alias("shard"))


def assign_shards(docs: DataFrame, key: str, weights: list[float], grown_weight: float | None = None) -> DataFrame:
    """Adds ``shard`` and, with ``grown_weight``, ``grown_shard``: the shard once one more of that weight exists.

    A null key is treated as an empty one; rows with equal keys share a shard.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = docs.withColumn("_best", rendezvous(text, weights)).withColumn("shard", F.col("_best.shard").cast("int"))
    if grown_weight is not None:
        more = len(weights)
        score = F.lit(float(grown_weight)) / -F.log(draw(text, more))
        out = out.withColumn("grown_shard", F.when(score > F.col("_best.score"), more).otherwise(F.col("shard")).cast("int"))
    return out.drop("_best")


def sharded(docs: DataFrame, key: str, text: str, weights: list[float], grown_weight: float | None = 1.0) -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length plus 8, so 8 for null and empty texts, whose CRC is 0. Slots count from 0 without gaps
    in the order of the key's hash, then the key; a shard's rows are counted in hash ranges, never in one task.
    An empty table gives an empty result; only the two named columns are read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        key_hash(key).alias("_hash"),
    )
    rows = scratch.keep(assign_shards(rows, key, weights, grown_weight), "shards")
    rows = rows.withColumn("_bucket", hash_bucket("_hash", bucket_count(rows.count()))).withColumn("_one", F.lit(1))
    order = [F.col("_hash"), F.col(key), F.col("size"), F.col("text_crc32")]
    placed = running_totals(rows, ["shard"], "_bucket", order, {"slot": "_one"})
    grown = F.col("grown_shard") if grown_weight is not None else F.lit(None).cast("int")
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))
