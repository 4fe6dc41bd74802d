"""Audit of filters that act one after another: who removes what in every order, from counts per coalition.

A filter set removes the documents that fail at least one of its filters, so everything about every order follows from
the number of documents per set of failed filters. With v(C) the documents that the coalition C removes, the
Hart-Mas-Colell potential is P(C) = (v(C) + sum of P(C without i) over i in C) / |C|, and the Shapley value of i is
P(all) - P(all without i). Potentials are kept as |C|! P(C), which are whole numbers.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import digest, words

LETTERS = "ABCDE"
COPY = "E"
SYMBOLS = "[#$%&*|]"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3


def text_failures(text: Column) -> dict[str, Column]:
    """The four conditions of the audit that a text alone decides; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    found = words(text)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(found) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(found)).cast("long") < MIN_DISTINCT_PERCENT * F.size(found).cast("long"),
        "C": 100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters, as bits in the order of the letters.

    The last bit is the copy filter: another row has the same text and a smaller key; a null key comes after every
    other, rows of one key are no copies of each other. Equal texts share the other bits, so copies are counted by
    (text digest, part, labels) with map-side sums, and a text that a third of all rows repeat is a few rows after
    that. Labels of a key are united; a null key has none. Parts are the values of ``part``, null as empty.
    """
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(text_failures(F.col(text)).values())), F.lit(0))
    rows = docs.select(
        F.col(key).alias("_key"), digest(text).alias("_digest"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        bits.cast("int").alias("_bits"),
    ).groupBy("_key", "_digest", "part", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    marks = labels.where("quality = 1 OR toxic = 1").groupBy(F.col(key).alias("_key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    )
    marked = rows.join(marks, "_key", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)).cast("long") for c in ("_good", "_toxic")}
    )
    copies = marked.groupBy("_digest", "part", "_bits", "_good", "_toxic").agg(
        F.sum("_n").alias("_n"), F.min("_key").alias("_least"), F.min_by("_n", "_key").alias("_at_least")
    )
    first = F.min("_least").over(Window.partitionBy("_digest"))
    unique = F.when(first.isNull(), F.col("_n")).when(F.col("_least") == first, F.col("_at_least")).otherwise(0)
    copies = copies.withColumn("_first", unique)
    each = F.explode(F.array(
        F.struct(F.col("_bits").alias("mask"), F.col("_first").alias("n")),
        F.struct((F.col("_bits") + (1 << LETTERS.index(COPY))).alias("mask"), (F.col("_n") - F.col("_first")).alias("n")),
    )).alias("_each")
    return (
        copies.select("part", "_good", "_toxic", each)
        .groupBy("part", F.col("_each.mask").alias("mask"))
        .agg(F.sum("_each.n").alias("n"), F.sum(F.expr("_each.n * _good")).alias("good"), F.sum(F.expr("_each.n * _toxic")).alias("toxic"))
    )


def coalition_values(counts: DataFrame, filters: int) -> DataFrame:
    """One row per part: what each coalition of filters removes (``v``, ``good``, ``toxic``, indexed by its bits)."""
    def removed(value: str) -> Column:
        per_set = [
            F.sum(F.when(F.col("mask").bitwiseAND(F.lit(c)) != 0, F.col(value)).otherwise(0)) for c in range(1 << filters)
        ]
        return F.array(*per_set).cast("array<bigint>").alias(value)

    return counts.groupBy("part").agg(F.sum("n").alias("total"), removed("n"), removed("good"), removed("toxic")).withColumnRenamed("n", "v")


def with_potentials(values: DataFrame, filters: int) -> DataFrame:
    """Adds ``potential``: |C|! P(C) of every coalition C, each from those with one filter less."""
    out = values.withColumn("_p0", F.lit(0).cast("long"))
    sets = range(1, 1 << filters)
    for size in range(1, filters + 1):
        out = out.withColumns({
            f"_p{c}": factorial(size - 1) * F.col("v")[c]
            + sum((F.col(f"_p{c ^ (1 << i)}") for i in range(filters) if c >> i & 1), F.lit(0))
            for c in sets if c.bit_count() == size
        })
    names = [f"_p{c}" for c in range(1 << filters)]
    return out.withColumn("potential", F.array(*names)).drop(*names)


def audit_orders(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``(part, mask, n, good, toxic)``.

    A step's counts are differences of two coalitions: the filters before it, and the same with it. ``shapley`` is the
    Shapley value times the number of orders.
    """
    k = len(letters)
    everyone = (1 << k) - 1
    steps = []
    for order in permutations(range(k)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order):
            steps.append({"filter_order": name, "step": step + 1, "before": before, "after": before | 1 << i, "own": 1 << i})
            before |= 1 << i
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, after: int, own: int>>")
    values = with_potentials(coalition_values(counts, k), k).withColumn("_step", F.explode(plan))

    def at(array: str, place: Column) -> Column:
        return F.get(F.col(array), place)

    before, after, own = F.col("_step.before"), F.col("_step.after"), F.col("_step.own")
    rest = F.lit(everyone) - own
    removed = at("v", after) - at("v", before)
    return values.select(
        "part", "_step.filter_order", "_step.step",
        (F.col("total") - at("v", after)).alias("kept"),
        removed.alias("removed"),
        (at("v", own) - removed).alias("redundant"),
        (at("v", F.lit(everyone)) - at("v", rest)).alias("unique_fails"),
        (at("good", after) - at("good", before)).alias("good_lost"),
        (at("toxic", after) - at("toxic", before)).alias("toxic_lost"),
        (at("potential", F.lit(everyone)) - k * at("potential", rest)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the five filters over all documents; no documents give no rows. A row counts as often as it is given."""
    return audit_orders(failure_counts(docs, labels, key, text, part))
