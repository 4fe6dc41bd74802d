"""Shallow baselines on one-hot features: boosted trees, k-means and kNN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.cards import DataCard
from rowloom.operators.boosting import DEPTH, ROUNDS, STEP, fit_boosted
from rowloom.operators.cluster import kmeans_sweep
from rowloom.operators.encoding import LevelCodes, one_hot_sparse
from rowloom.operators.knn import K_VALUES, knn_sweep
from rowloom.operators.metrics import balanced_accuracy, mse
from rowloom.operators.sampling import cached, with_split


def tree_baseline(df: DataFrame, card: DataCard, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP) -> DataFrame:
    """(split, score) of boosted trees fitted on all train rows: softmax over the classes, or squared error.

    Levels and classes that train rows lack are no level of a split and never predicted.
    """
    response, coded = card.response, df
    sizes: list[int] = []
    if card.cat_features:
        levels = LevelCodes.fit(df, card.cat_features, order="numeric", train_only=True, unseen="null")
        coded, sizes = levels.transform(df), [levels.sizes[c] for c in card.cat_features]
    classes = 0
    if card.task != "regression":
        answers = LevelCodes.fit(df, [response], order="numeric", train_only=True, unseen="keep")
        coded, classes = answers.transform(coded), answers.sizes[response]
    coded = cached(coded.select("split", *[F.col(f"`{c}`") for c in (*card.cat_features, *card.num_features, response)]))
    model = fit_boosted(
        coded.filter(F.col("split") == "train"), card.cat_features, sizes, card.num_features, response, classes, rounds, depth, step
    )
    scored = model.predict(coded.filter(F.col("split") != "train"), card.cat_features, card.num_features)
    rule = mse if card.task == "regression" else balanced_accuracy
    return rule(scored.withColumn("target", F.col(f"`{response}`").cast("double")), "target", "prediction", ["split"])


def shallow_scores(
    features: DataFrame,
    key: str,
    task: str | None,
    ks: tuple[int, ...] = K_VALUES,
    max_train_rows: int | None = None,
    seed: int = 0,
    points: str | None = None,
    categories: int = 0,
) -> tuple[float | None, float | None]:
    """Test silhouette of the chosen k-means and test score of the chosen kNN for (key, split, features, target).

    All train rows take part; ``max_train_rows`` bounds the labelled rows of the classifying kNN alone, by key hash.
    """
    features = cached(features)
    clustering = kmeans_sweep(features, key, "features", ks, seed, points=points, categories=categories).filter("chosen").first()
    prediction = None
    if task is not None:
        bound = max_train_rows if task == "classification" else None
        sweep = knn_sweep(features, key, "features", "target", task, ks, max_train_rows=bound, categories=categories)
        prediction = sweep.filter("chosen").first()["test_score"]
    features.unpersist()
    return (clustering["test_score"] if clustering else None), prediction


def coded_features(df: DataFrame, card: DataCard) -> DataFrame:
    """(key, split, features, points, target): category codes before numbers, and the same as sparse one-hot vectors.

    Codes stand for one-hot vectors in distances, so wide categories cost no more than narrow ones. Levels that
    train rows lack get -1, the all-zero vector; missing numbers count as 0.
    """
    sparse = one_hot_sparse(df, card.cat_features, card.num_features, output="points")
    coded = sparse
    if card.cat_features:
        coded = LevelCodes.fit(df, card.cat_features, order="numeric", train_only=True, unseen="null").transform(sparse)
    if card.task == "classification":
        coded = LevelCodes.fit(df, [card.response], order="numeric", train_only=True, unseen="keep").transform(coded)
    codes = [F.coalesce(F.col(f"`{v}`").cast("double"), F.lit(-1.0)) for v in card.cat_features]
    numbers = [F.coalesce(F.col(f"`{v}`").cast("double"), F.lit(0.0)) for v in card.num_features]
    return coded.select(
        card.key, "split", F.array(*codes, *numbers).alias("features"), "points", F.col(f"`{card.response}`").cast("double").alias("target")
    )


def baseline_run(df: DataFrame, card: DataCard, replicate: int = 0, rounds: int = ROUNDS, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """One row (replicate, kmeans_perf, knn_perf, predictor_perf) for a tabular card with a response.

    Each replicate splits the table anew.
    """
    if card.txt or card.dense or card.response is None:
        raise ValueError("the baseline takes tables of categories and numbers with a response")
    df = cached(with_split(df.drop("split"), card.key, seed=replicate))
    trees = {r["split"]: r["score"] for r in tree_baseline(df, card, rounds=rounds).collect()}
    kmeans_perf, knn_perf = shallow_scores(
        coded_features(df, card), card.key, card.task, ks, seed=replicate, points="points", categories=len(card.cat_features)
    )
    df.unpersist()
    return df.sparkSession.createDataFrame(
        [(replicate, kmeans_perf, knn_perf, trees.get("test"))],
        "replicate int, kmeans_perf double, knn_perf double, predictor_perf double",
    )
