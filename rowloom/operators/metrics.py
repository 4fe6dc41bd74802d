"""Scores of predictions and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced_accuracy(df: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """Mean over true classes of the recall: (by..., score)."""
    hit = (F.col(y) == F.col(prediction)).cast("double")
    recalls = df.groupBy(*by, y).agg(F.avg(F.coalesce(hit, F.lit(0.0))).alias("recall"))
    return recalls.groupBy(*by).agg(F.avg("recall").alias("score"))


def mse(df: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    error = F.col(y) - F.col(prediction)
    return df.groupBy(*by).agg(F.avg(error * error).alias("score"))


def rounded_labels(df: DataFrame, column: str) -> DataFrame:
    """Numeric predictions to the nearest class code."""
    return df.withColumn(column, F.round(column).cast("int"))


def epoch_loss(df: DataFrame, loss: str, by: list[str]) -> DataFrame:
    """Mean of the batch losses, not weighted by batch size."""
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"))


def imputation_scores(df: DataFrame, batch: str = "batch_id", scope: str = "all") -> DataFrame:
    """Per-variable score of imputed values: (variable, kind, score).

    ``df`` has one row per imputed cell: batch, variable, kind (cat or num), truth, estimate. Each batch is
    scored on its own; ``scope='all'`` averages the batches, ``'last_batch'`` keeps the last one's score.
    """
    cat, num = df.filter(F.col("kind") == "cat"), df.filter(F.col("kind") == "num")
    keys = ["variable", "kind", batch]
    per_batch = balanced_accuracy(cat, "truth", "estimate", keys).unionByName(mse(num, "truth", "estimate", keys))
    if scope == "last_batch":
        return per_batch.groupBy("variable", "kind").agg(F.max_by("score", batch).alias("score"))
    return per_batch.groupBy("variable", "kind").agg(F.avg("score").alias("score"))
