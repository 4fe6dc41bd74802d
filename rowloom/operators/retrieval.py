"""Similarities inside batches: positives, contrastive losses, and imputation by retrieval.

A batch has a fixed number of rows (see ``assign_batches``), so its similarity matrix is bounded; only
per-row or per-batch results leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.vectors import NORM_FLOOR, doubles, matrix

SIMILARITY_DIGITS = 9  # similarities equal to this many digits are ties; the first candidate wins


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), NORM_FLOOR)


def similarity(x: np.ndarray, y: np.ndarray, measure: str = "cosine", temperature: float = 1.0) -> np.ndarray:
    if measure == "dot":
        return x @ y.T
    return unit_rows(x) @ unit_rows(y).T / temperature


def log_partition(sims: np.ndarray) -> np.ndarray:
    top = sims.max(axis=1)
    return top + np.log(np.exp(sims - top[:, None]).sum(axis=1))


def diagonal_cross_entropy(sims: np.ndarray) -> float:
    return float((log_partition(sims) - np.diag(sims)).mean())


def first_best(sims: np.ndarray, axis: int) -> np.ndarray:
    return np.round(sims, SIMILARITY_DIGITS).argmax(axis=axis)


def batch_similarity(df: DataFrame, key: str, a: str, b: str, measure: str = "cosine", temperature: float = 1.0) -> DataFrame:
    """Per row of a batch: similarity to its own partner, best partner, and log of the summed exponentials."""
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        sims = similarity(matrix(batch.column("a")), matrix(batch.column("b")), measure, temperature)
        best = first_best(sims, axis=1)
        return pa.table(
            {
                "batch_id": batch.column("batch_id"),
                key: batch.column(key),
                "positive": pa.array(np.diag(sims)),
                "best_key": batch.column(key).combine_chunks().take(pa.array(best)),
                "best": pa.array(sims[np.arange(len(sims)), best]),
                "log_partition": pa.array(log_partition(sims)),
            }
        )

    sides = df.select("batch_id", "pos", key, doubles(a).alias("a"), doubles(b).alias("b"))
    schema = f"batch_id bigint, {key} {kind}, positive double, best_key {kind}, best double, log_partition double"
    return sides.groupBy("batch_id").applyInArrow(work, schema)


def batch_contrastive_loss(df: DataFrame, vectors: list[str], temperature: float = 1.0) -> DataFrame:
    """Per batch: each variable's similarities to all others are summed, scored by cross-entropy with the own
    row as the label, and averaged over variables: (batch_id, n, loss)."""
    if len(vectors) < 2:
        raise ValueError("a contrastive loss needs two variables or more")

    def work(batch: pa.Table) -> pa.Table:
        parts = [matrix(batch.column(v)) for v in vectors]
        losses = [
            diagonal_cross_entropy(sum(similarity(x, y, temperature=temperature) for j, y in enumerate(parts) if j != i))
            for i, x in enumerate(parts)
        ]
        return pa.table({"batch_id": batch.column("batch_id").slice(0, 1), "n": pa.array([len(batch)], pa.int64()),
                         "loss": pa.array([float(np.mean(losses))])})

    sides = df.select("batch_id", *[doubles(v).alias(v) for v in vectors])
    return sides.groupBy("batch_id").applyInArrow(work, "batch_id bigint, n bigint, loss double")


def retrieve(
    df: DataFrame,
    key: str,
    variable: str,
    value: str,
    query_vector: str,
    evidence: list[str],
    kind: str,
    rule: str = "sum",
    measure: str = "cosine",
    temperature: float = 1.0,
) -> DataFrame:
    """Impute ``value`` of every row by the batch row whose query vector fits the row's evidence best.

    ``rule='sum'`` adds the similarities to each evidence vector; ``'mean'`` compares with the mean evidence
    vector. Result: (batch_id, key, variable, kind, truth, estimate).
    """
    key_type = df.schema[key].dataType.simpleString()

    def work(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        candidates = matrix(batch.column("query"))
        parts = [matrix(batch.column(f"e{i}")) for i in range(len(evidence))]
        if rule == "mean":
            sims = similarity(candidates, sum(parts) / len(parts), measure, temperature)
        else:
            sims = sum(similarity(candidates, part, measure, temperature) for part in parts)
        chosen = pa.array(first_best(sims, axis=0))
        return pa.table({"batch_id": batch.column("batch_id"), key: batch.column(key), "truth": batch.column("truth"),
                         "estimate": batch.column("truth").combine_chunks().take(chosen)})

    sides = df.select(
        "batch_id", "pos", key, F.col(value).cast("double").alias("truth"), doubles(query_vector).alias("query"),
        *[doubles(v).alias(f"e{i}") for i, v in enumerate(evidence)],
    )
    found = sides.groupBy("batch_id").applyInArrow(work, f"batch_id bigint, {key} {key_type}, truth double, estimate double")
    return found.select("batch_id", key, F.lit(variable).alias("variable"), F.lit(kind).alias("kind"), "truth", "estimate")
