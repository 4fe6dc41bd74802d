"""Run sweeps: every configuration of a grid gives one result row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.cards import DataCard
from rowloom.models.embedder import RowPacker, TableEmbedder, TablePredictor
from rowloom.models.networks import TRANSFER_METHODS
from rowloom.models.trainer import Settings
from rowloom.operators.knn import K_VALUES
from rowloom.operators.metrics import imputation_scores
from rowloom.operators.sampling import cached, with_split
from rowloom.plans.baseline import shallow_scores
from rowloom.sources.grids import RunGrid
from rowloom.sources.results import RESULT_SCHEMA


def run_one(packed: DataFrame, packer: RowPacker, name: str, replicate: int, batch_size: int, rate: float, latent: int,
            method: str, grid: RunGrid, ks: tuple[int, ...] = K_VALUES) -> tuple:
    """Train, embed, evaluate and predict for one configuration: one row of ``RESULT_SCHEMA``."""
    settings = Settings(epochs=grid.epochs, batch_size=batch_size, learning_rate=rate, seed=replicate)
    card, model = packer.card, None
    embedder_params = embedder_losses = kmeans_perf = knn_perf = None
    imputed: dict[str, float] = {}
    if method != "CONTROL":
        model = TableEmbedder(method, latent, grid.hidden, grid.phi, settings).fit_packed(packed, packer)
        embedder_params, embedder_losses = model.design.parameter_count(), model.trained.last_losses
        if card.response is not None:
            features = model.transform_packed(packed).withColumnRenamed("embedding", "features")
            kmeans_perf, knn_perf = shallow_scores(features, card.key, card.task, ks, seed=replicate)
        if method in TRANSFER_METHODS:
            test = packed.filter(F.col("split") == "test")
            imputed = {r["variable"]: r["score"] for r in imputation_scores(model.impute_packed(test, batch_size)).collect()}
    predictor_params = predictor_losses = predictor_perf = None
    if card.response is not None:
        head = TablePredictor(latent, Settings(grid.epochs, batch_size, rate, patience=10, seed=replicate))
        predictor = head.fit_packed(packed, packer, model)
        predictor_params, predictor_losses = predictor.trained.design.parameter_count(), predictor.trained.last_losses
        scores = {r["split"]: r["score"] for r in predictor.score(packed.filter(F.col("split") == "test")).collect()}
        predictor_perf = scores.get("test")
    run_id = f"{replicate}-{batch_size}-{rate}-{latent}-{method}"
    return (name, run_id, replicate, batch_size, rate, latent, method, embedder_params, *(embedder_losses or (None, None)),
            kmeans_perf, knn_perf, predictor_params, *(predictor_losses or (None, None)), predictor_perf, imputed)


def run_sweep(df: DataFrame, card: DataCard, name: str, grid: RunGrid, ks: tuple[int, ...] = K_VALUES,
              sink: Callable[[DataFrame], None] | None = None, presplit: bool = False) -> DataFrame:
    """Result rows of all configurations. Each replicate splits and packs the table once; ``sink`` gets every
    finished row, so that a broken sweep keeps what it has."""
    spark, rows = df.sparkSession, []
    for replicate in range(grid.replicates):
        split = df if presplit else with_split(df.drop("split"), card.key, seed=replicate)
        packer = RowPacker.fit(split, card)
        packed = cached(packer.transform(split))
        for _, batch_size, rate, latent, method in (c for c in grid.configurations() if c[0] == replicate):
            rows.append(run_one(packed, packer, name, replicate, batch_size, rate, latent, method, grid, ks))
            if sink is not None:
                sink(spark.createDataFrame(rows[-1:], RESULT_SCHEMA))
        packed.unpersist()
    return spark.createDataFrame(rows, RESULT_SCHEMA)
