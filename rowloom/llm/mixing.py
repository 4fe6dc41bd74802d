"""Mixing of sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import FEW_ROWS, ROW_ID, Scratch, bucket_count, hash_bucket, identified, key_hash, running_totals, words

#: Virtual time at which the targets are reached.
CLOCK = 1.0


def targets(sources: DataFrame, weights: tuple[int, ...], most: int, share: float = 1.0) -> DataFrame:
    """Adds ``_rank``, ``_weight`` and ``target`` to rows (source, source_size).

    Weights repeat over the sources in code point order, null last. Targets split ``share`` of all tokens by weight;
    none exceeds ``most`` times its source, and the excess is shared again by weight: with sources in the order of
    size per weight, the first ones are full and the level of the rest follows from running sums. The windows hold
    one small row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("_rank", F.row_number().over(by_name) - 1)
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn("_weight", F.element_at(pattern, (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    everything = Window.orderBy("_unit").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.withColumn("_unit", F.lit(0)).withColumns({
        "_budget": F.sum("source_size").over(everything) * F.lit(share),
        "_full": F.coalesce(F.sum("_cap").over(fill), F.lit(0)),
        "_rest": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(fill), F.lit(0)),
    })
    levels = levels.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_rest"))
    # the first source below its cap fixes the level; without one all are full
    open_level = F.when(F.col("_cap") >= F.col("_level") * F.col("_weight"), F.struct("_full", "_rank", "_level"))
    levels = levels.withColumn("_open", F.min(open_level).over(everything)["_level"])
    target = F.when(F.col("_open").isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), F.col("_open") * F.col("_weight"))
    )
    return levels.select("source", "source_size", "_rank", "_weight", target.alias("target"))


def queue(docs: DataFrame, key: str, source: str, size: Column, weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
          share: float = 1.0, scratch: Scratch | None = None) -> DataFrame:
    """The mix: one row per copy of a document that it serves, with its place.

    Columns: the key, size, source, source_size, target, _slot (place in the shuffled source), epoch, begin and finish
    (virtual times), take (tokens served) and mix_from (tokens served before it). Each source is shuffled by key hash
    and read up to ``most`` times. A copy's finish is the source's tokens up to its end over the target; copies are
    range-sorted by it over all sources. Targets add up to the budget, so the mix ends at virtual time 1: copies that
    end by then are whole, and the copy that a source is serving then is cut there. Documents without tokens are
    served by none: their copies have take 0, and so do sources without tokens.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.keep(
        docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), size.cast("long").alias("size"), key_hash(key).alias("_hash")),
        "mix_sizes",
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = scratch.keep(targets(sums, weights, most, share), "mix_targets")
    # one row per source: a source name is looked up, never a document
    ranked = rows.join(aims, rows["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    buckets = bucket_count(rows.count())
    ranked = ranked.withColumn("_bucket", hash_bucket("_hash", buckets)).withColumn("_one", F.lit(1))
    order = [F.col("_hash"), F.col("_key"), F.col("size")]
    placed = running_totals(ranked, ["_rank"], "_bucket", order, {"_before": "size", "_slot": "_one"}).drop("_bucket", "_one")
    copies = placed.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(most)])))
    started = F.col("epoch") * F.col("source_size") + F.col("_before")
    copies = copies.withColumns({"begin": started / F.col("target"), "finish": (started + F.col("size")) / F.col("target")})
    cut = F.floor(F.col("target") - started)
    take = F.when(F.col("finish") <= CLOCK, F.col("size")).when(F.col("begin") < CLOCK, cut).otherwise(0)
    copies = copies.withColumn("take", F.coalesce(take, F.lit(0)).cast("long"))
    # documents that get nothing stay, with one row, so that every document has its row in the end
    served = copies.filter("take > 0 OR epoch = 0")
    clock = F.floor(F.least("finish", F.lit(CLOCK)) * buckets).cast("long")
    unserved = buckets + 1 + hash_bucket("_hash", buckets)  # nothing orders these; they are spread
    served = served.withColumn("_clock", F.when(F.col("take") > 0, clock).otherwise(unserved))
    by_time = [F.col("finish"), F.col("_rank"), F.col("_hash"), F.col("_key"), F.col("_slot"), F.col("epoch")]
    return running_totals(served, [], "_clock", by_time, {"mix_from": "take"}).drop("_clock").withColumnRenamed("_key", key)


def mixture(docs: DataFrame, key: str, source: str, size: Column, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per document: key, size, source_size, target, taken and mix_from (of its first copy; null if none).

    Null and empty texts have size 0 and are never taken; repeated rows are separate documents; a null source is a
    source of its own. An empty table gives an empty result.
    """
    served = queue(docs, key, source, size, weights, most)
    return served.groupBy("_rank", "_slot", key, "size", "source_size", "target").agg(
        F.sum("take").alias("taken"), F.min(F.when(F.col("take") > 0, F.col("mix_from"))).alias("mix_from")
    ).drop("_rank", "_slot")


def word_count(text: str) -> Column:
    return F.size(words(F.col(text)))


def mixed(docs: DataFrame, key: str, source: str, size: Column, weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
          text: str = "text") -> DataFrame:
    """The rows of the mix with all their columns: each document as often as it is served whole.

    Rows are told apart by key, text and source. Rows that repeat all three are served as often as all of them together; the
    least of them stands for each.
    """
    scratch = Scratch(docs.sparkSession)
    rows = identified(docs, key, text, scratch).rows
    served = queue(rows, ROW_ID, source, size, weights, most, scratch=scratch).filter("take > 0 AND take = size")
    times = served.groupBy(F.col(ROW_ID).alias("_served"), F.col("source").alias("_from")).agg(F.count("*").cast("int").alias("_times"))
    here = (F.col(ROW_ID) == F.col("_served")) & F.col(source).eqNullSafe(F.col("_from"))
    again = rows.groupBy(ROW_ID, source).count().filter("count > 1").select(F.col(ROW_ID).alias("_served"), F.col(source).alias("_from"))
    again = scratch.keep(again, "mix_repeated")
    n = again.count()
    once = rows
    if n:
        again = F.broadcast(again) if n <= FEW_ROWS else again
        least = rows.join(again, here, "left_semi").groupBy(ROW_ID, source).agg(F.min(F.struct(*[rows[c] for c in rows.columns])).alias("_row"))
        once = rows.join(again, here, "left_anti").unionByName(least.select("_row.*"))
    out = once.join(times, here)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
