"""Result files in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.cards import DataCard

RUN_KEYS = ["batch_size", "learning_rate", "latent_dim", "model_type", "embedder_params", "predictor_params"]
METRICS = ["kmeans_perf", "knn_perf", "predictor_perf"]
RESULT_SCHEMA = (
    "dataset string, run_id string, replicate int, batch_size int, learning_rate double, latent_dim int, method string, "
    "embedder_params bigint, embedder_train_loss double, embedder_valid_loss double, kmeans_perf double, knn_perf double, "
    "predictor_params bigint, predictor_train_loss double, predictor_valid_loss double, predictor_perf double, "
    "imputed map<string,double>"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header whose first column is a row index; the index is dropped, numbers become doubles."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.drop(raw.columns[0])
    text = {"model_type", "name", "prediction_task"}
    return raw.select(*[F.col(f"`{c}`").try_cast("string" if c in text else "double").alias(c) for c in raw.columns])


def run_cells(runs: DataFrame, name: str, card: DataCard) -> DataFrame:
    """Imputed variables of a wide run table in long form: (name, run, variable, kind, value)."""
    kinds = {**{v: "cat" for v in card.cat_features}, **{v: "num" for v in card.num_features}}
    present = [v for v in runs.columns if v in kinds]
    cells = [F.struct(F.lit(v).alias("variable"), F.lit(kinds[v]).alias("kind"), F.col(f"`{v}`").alias("value")) for v in present]
    return runs.select(F.lit(name).alias("name"), "run", F.inline(F.array(*cells)))


def with_run_numbers(runs: DataFrame) -> DataFrame:
    """Number the runs of one result file by their configuration, for joins with their cells."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RUN_KEYS if c in runs.columns]
    return runs.withColumn("run", F.concat_ws("|", *parts))


def read_experiments(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Run tables ``<name>_experiment.csv`` that exist in the folder, by dataset name."""
    paths = {n: f"{folder}/{n}_experiment.csv" for n in names}
    return {n: with_run_numbers(read_result_csv(spark, p)) for n, p in paths.items() if path_exists(spark, p)}


def read_benchmarks(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Mean metrics of ``<name>_benchmark.csv`` over replicates, one row per dataset: (name, model_type, metrics)."""
    found = []
    for n in names:
        path = f"{folder}/{n}_benchmark.csv"
        if path_exists(spark, path):
            table = read_result_csv(spark, path)
            found.append(table.agg(*[F.avg(m).alias(m) for m in METRICS]).select(F.lit(n).alias("name"), F.lit("benchmark").alias("model_type"), *METRICS))
    if not found:
        raise FileNotFoundError(f"no benchmark files in {folder}")
    return reduce(lambda a, b: a.unionByName(b), found)


def append_results(results: DataFrame, path: str) -> None:
    """Write result rows under dataset and run; a run that is written again replaces its earlier rows."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "run_id").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).parquet(path)


def export_csv(table: DataFrame, path: str) -> None:
    """A small final table as one CSV file in a folder."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
