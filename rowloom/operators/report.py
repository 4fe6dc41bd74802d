"""From run results to best-of tables, relative scores, win rates, averages and significance tests.

Scores travel in long form: ``section`` (the evaluation), ``task``, ``name`` (the table), ``method``, ``value``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.stats import upper_tail
from rowloom.operators.lookup import lookup_join
from rowloom.operators.sampling import cached

# The evaluations whose greatest value is best whatever the task.
GREATER_IS_BETTER = ("Imputation", "Clustering")


def replicate_mean(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean of the metrics over replicates; rows whose keys are null form groups of their own."""
    return results.groupBy(*by).agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in metrics])


def column_means(results: DataFrame, metrics: list[str], label: str, value: str) -> DataFrame:
    """One row with the mean of each metric and a literal label column."""
    return results.agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in metrics]).withColumn(label, F.lit(value))


def row_mean(columns: list[str]):
    """Mean over columns of one row, nulls skipped."""
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    present = reduce(lambda a, b: a + b, [v.isNotNull().cast("double") for v in values])
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values]), present)


def rescale(value, low, high):
    """(x - low) / (high - low); null where the range is empty."""
    return F.try_divide(value - low, high - low)


def imputation_score(cells: DataFrame, run: list[str]) -> DataFrame:
    """Score per run: each variable is min-max scaled over all runs of its table, errors are reversed, and the
    scaled values are averaged. ``cells``: (name, run..., variable, kind, value) -> (name, run..., score).

    Ranges come from a partial aggregate joined back, not from a window, as a table may have any number of runs.
    """
    cells = cached(cells)
    ranges = cells.groupBy("name", "variable").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    share = rescale(F.col("value"), F.col("low"), F.col("high"))
    scaled = lookup_join(cells, ranges, ["name", "variable"]).withColumn(
        "scaled", F.when(F.col("kind") == "cat", share).otherwise(1.0 - share)
    )
    return scaled.groupBy("name", *run).agg(F.avg("scaled").alias("score"))


def best_per_method(results: DataFrame, metric: str, section: str, percent: bool = False) -> DataFrame:
    """Best value per table and method: the greatest, except for the error metrics of regression tables."""
    value = F.max(metric)
    if section not in GREATER_IS_BETTER:
        value = F.when(F.col("task") == "classification", F.max(metric) * (100.0 if percent else 1.0)).otherwise(F.min(metric))
    return results.groupBy("task", "name", "method").agg(value.alias("value")).select(
        F.lit(section).alias("section"), "task", "name", "method", "value"
    )


def best_row_per_group(results: DataFrame, group: str, score: str, tiebreak: str) -> DataFrame:
    """The row with the greatest score of each group; ties go to the smallest tiebreak. One partial aggregate."""
    rest = [c for c in results.columns if c != group]
    place = F.struct(F.col(score), (-F.col(tiebreak)).alias("_t"))
    return results.groupBy(group).agg(F.max_by(F.struct(*rest), place).alias("row")).select(group, "row.*")


def method_columns(scores: DataFrame, methods: list[str], by: tuple[str, ...] = ("task", "name")) -> DataFrame:
    """Methods to columns in the given order; a missing method is null."""
    return scores.groupBy(*by).pivot("method", methods).agg(F.first("value"))


def relative_scores(scores: DataFrame) -> DataFrame:
    """Min-max over the methods of a table: 0 worst, 1 best; error metrics are reversed; no range gives null."""
    table = Window.partitionBy("section", "task", "name")
    share = rescale(F.col("value"), F.min("value").over(table), F.max("value").over(table))
    reverse = ~F.col("section").isin(*GREATER_IS_BETTER) & (F.col("task") == "regression")
    return scores.withColumn("value", F.when(reverse, 1.0 - share).otherwise(share))


def win_rates(relative: DataFrame) -> DataFrame:
    """Share of tables on which ``winner`` is strictly better than ``loser``, over tables that have both."""
    present = relative.filter(F.col("value").isNotNull()).select("section", "task", "name", "method", "value")
    other = present.select("section", "task", "name", F.col("method").alias("loser"), F.col("value").alias("other"))
    return (
        present.join(other, ["section", "task", "name"])
        .filter(F.col("method") != F.col("loser"))
        .groupBy("section", F.col("method").alias("winner"), "loser")
        .agg(F.avg((F.col("value") > F.col("other")).cast("double")).alias("share"), F.count(F.lit(1)).alias("tables"))
    )


def grand_table(relative: DataFrame, sections: list[str], methods: list[str] | None = None) -> DataFrame:
    """Mean relative score: one row per method, one column per section."""
    table = relative.groupBy("method").pivot("section", sections).agg(F.avg("value"))
    if methods is None:
        return table
    place = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    return table.filter(F.col("method").isin(*methods)).orderBy(place)


def welch_test(relative: DataFrame, method: str, baselines: list[str]) -> DataFrame:
    """One-sided test per section that ``method`` exceeds all baselines pooled, unequal variances: (section, t, df, p)."""
    own, rest = F.col("method") == method, F.col("method").isin(*baselines)
    moments = []
    for tag, side in (("a", own), ("b", rest)):
        value = F.when(side, F.col("value"))
        moments += [F.avg(value).alias(f"m{tag}"), F.var_samp(value).alias(f"v{tag}"), F.count(value).alias(f"n{tag}")]
    a, b = F.try_divide("va", "na"), F.try_divide("vb", "nb")
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(a + b))
    freedom = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("na") - 1) + F.try_divide(b * b, F.col("nb") - 1))
    tests = relative.groupBy("section").agg(*moments).select("section", t.alias("t"), freedom.alias("df"))
    return tests.withColumn("p", upper_tail("t", "df"))


def paired_test(relative: DataFrame, method: str, baselines: list[str]) -> DataFrame:
    """One-sided paired test per section and baseline, over tables that have both: (section, baseline, t, df, p)."""
    present = relative.filter(F.col("value").isNotNull())
    own = present.filter(F.col("method") == method).select("section", "task", "name", F.col("value").alias("own"))
    rest = present.filter(F.col("method").isin(*baselines)).select("section", "task", "name", F.col("method").alias("baseline"), "value")
    gap = F.col("own") - F.col("value")
    tests = (
        rest.join(own, ["section", "task", "name"])
        .groupBy("section", "baseline")
        .agg(F.avg(gap).alias("m"), F.stddev_samp(gap).alias("s"), F.count(gap).alias("n"))
        .select(
            "section", "baseline",
            F.try_divide(F.col("m") * F.sqrt(F.col("n").cast("double")), F.col("s")).alias("t"),
            (F.col("n") - 1).cast("double").alias("df"),
        )
    )
    return tests.withColumn("p", upper_tail("t", "df"))


def with_display_names(results: DataFrame, names: dict[str, str], column: str = "method") -> DataFrame:
    """Map method codes to display names; a code without a name becomes null."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return results.withColumn(column, F.element_at(pairs, F.col(column)))


def with_profile(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add task, samples and variable counts to the results of each table."""
    return lookup_join(results.withColumnRenamed("dataset", "name"), profiles, ["name"], how="inner")
