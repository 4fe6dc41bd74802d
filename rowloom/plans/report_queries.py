"""Result analysis over scores derived from the given tables, each query with its SQL counterpart.

Runs are customers: the nation is the benchmark table, the market segment the method, and the customer's
orders give the metrics. Orders are reduced per customer before they meet the customer table, so a customer
with very many orders costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import report
from rowloom.operators.early_stop import early_stop
from rowloom.operators.metrics import epoch_loss
from rowloom.plans.inputs import rounded, table

SECTIONS = ["Imputation", "Clustering", "Supervised learning", "Transfer learning"]
METRICS = dict(zip(SECTIONS, ["imputation_perf", "kmeans_perf", "knn_perf", "predictor_perf"]))
METHODS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
OWN, BASELINES = METHODS[1], [METHODS[0], *METHODS[2:]]
PATIENCE = 5
DELTA = 2.5
PANELS = 2000  # of the numeric integration in the SQL counterpart of the p-values


def runs(spark: SparkSession, folder: str) -> DataFrame:
    per_customer = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("imputation_perf"),
        F.avg("o_totalprice").alias("kmeans_perf"),
        F.min("o_totalprice").alias("knn_perf"),
        F.count(F.lit(1)).cast("double").alias("predictor_perf"),
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation")
    task = F.when(F.col("n_regionkey") % 2 == 0, "classification").otherwise("regression")
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("name"), task.alias("task"), F.col("c_mktsegment").alias("method"),
                F.col("c_custkey").alias("run"), *METRICS.values())
    )


def best_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Best value per section, table and method from one aggregate over the runs."""
    results = runs(spark, folder)
    extremes = results.groupBy("task", "name", "method").agg(
        *[F.max(m).alias(f"max_{m}") for m in METRICS.values()], *[F.min(m).alias(f"min_{m}") for m in METRICS.values()]
    )
    cells = []
    for section, metric in METRICS.items():
        best = F.col(f"max_{metric}")
        if section not in report.GREATER_IS_BETTER:
            best = F.when(F.col("task") == "classification", best).otherwise(F.col(f"min_{metric}"))
        cells.append(F.struct(F.lit(section).alias("section"), best.alias("value")))
    return extremes.select("task", "name", "method", F.inline(F.array(*cells)))


def replicate_mean(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    df = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return report.replicate_mean(df, ["lang", "quality"], ["n_chars"]).select("lang", "quality", rounded("n_chars"))


def best_per_method(spark: SparkSession, folder: str) -> DataFrame:
    best = report.best_per_method(runs(spark, folder), "knn_perf", "Supervised learning", percent=True)
    return best.select("section", "task", "name", "method", rounded("value"))


def benchmark_means(spark: SparkSession, folder: str) -> DataFrame:
    means = report.column_means(runs(spark, folder), list(METRICS.values()), "method", "benchmark")
    return means.select("method", *[rounded(m) for m in METRICS.values()])


def row_means(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    df = table(spark, folder, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return df.select("doc_id", F.round(report.row_mean(["n_chars", "quality", "toxic"]), 6).alias("mean"))


def imputation_score(spark: SparkSession, folder: str) -> DataFrame:
    cells = F.array(
        F.struct(F.lit("orders").alias("variable"), F.lit("cat").alias("kind"), F.col("predictor_perf").alias("value")),
        F.struct(F.lit("price").alias("variable"), F.lit("num").alias("kind"), F.col("kmeans_perf").alias("value")),
    )
    scores = report.imputation_score(runs(spark, folder).select("name", "run", F.inline(cells)), ["run"])
    return scores.select("name", "run", rounded("score"))


def relative_score(spark: SparkSession, folder: str) -> DataFrame:
    return report.relative_scores(best_scores(spark, folder)).select("section", "task", "name", "method", rounded("value"))


def method_table(spark: SparkSession, folder: str) -> DataFrame:
    best = best_scores(spark, folder).filter(F.col("section") == "Clustering")
    wide = report.method_columns(best, METHODS)
    return wide.select("task", "name", *[rounded(m) for m in METHODS])


def win_matrix(spark: SparkSession, folder: str) -> DataFrame:
    wins = report.win_rates(report.relative_scores(best_scores(spark, folder)))
    return wins.select("section", "winner", "loser", rounded("share"), "tables")


def grand_table(spark: SparkSession, folder: str) -> DataFrame:
    wide = report.grand_table(report.relative_scores(best_scores(spark, folder)), SECTIONS, METHODS)
    return wide.select("method", *[F.round(F.col(s), 6).alias(s.split()[0].lower()) for s in SECTIONS])


def welch_t(spark: SparkSession, folder: str) -> DataFrame:
    tests = report.welch_test(report.relative_scores(best_scores(spark, folder)), OWN, BASELINES)
    return tests.select("section", rounded("t"), rounded("df"))


def paired_t(spark: SparkSession, folder: str) -> DataFrame:
    tests = report.paired_test(report.relative_scores(best_scores(spark, folder)), OWN, BASELINES)
    return tests.select("section", "baseline", rounded("t"), "df")


def significance(spark: SparkSession, folder: str) -> DataFrame:
    """Both tests with their p-values."""
    relative = report.relative_scores(best_scores(spark, folder))
    pooled = report.welch_test(relative, OWN, BASELINES).withColumn("baseline", F.lit("all"))
    both = pooled.unionByName(report.paired_test(relative, OWN, BASELINES))
    return both.select("section", "baseline", rounded("t"), rounded("df"), rounded("p"))


def best_row_per_group(spark: SparkSession, folder: str) -> DataFrame:
    best = report.best_row_per_group(runs(spark, folder), "method", "imputation_perf", "run")
    return best.select("method", "name", "task", "run", rounded("imputation_perf"))


def profile_join(spark: SparkSession, folder: str) -> DataFrame:
    results = runs(spark, folder).groupBy("name").agg(F.max("kmeans_perf").alias("best")).withColumnRenamed("name", "dataset")
    profiles = table(spark, folder, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("samples"))
    return report.with_profile(results, profiles).select("name", "samples", rounded("best"))


def display_names(spark: SparkSession, folder: str) -> DataFrame:
    names = {METHODS[0]: "Autos", METHODS[1]: "Builders", METHODS[2]: "Furnishers"}
    named = report.with_display_names(runs(spark, folder), names)
    return named.groupBy("method").agg(F.count(F.lit(1)).alias("runs"))


def loss_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's daily mean value as a loss track."""
    df = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("epoch"), "value")
    return epoch_loss(df, "value", ["user_id", "epoch"])


def epoch_losses(spark: SparkSession, folder: str) -> DataFrame:
    return loss_tracks(spark, folder).select("user_id", F.col("epoch").cast("string").alias("epoch"), rounded("loss"))


def early_stop_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Only losses better by ``DELTA`` count as an improvement."""
    ends = early_stop(loss_tracks(spark, folder), "user_id", "epoch", "loss", PATIENCE, delta=DELTA)
    return ends.select(
        "user_id", F.col("stop_epoch").cast("string").alias("stop_epoch"),
        F.col("kept_epoch").cast("string").alias("kept_epoch"), rounded("last_loss"), "stopped",
    )


def early_stop_epoch(spark: SparkSession, folder: str) -> DataFrame:
    ends = early_stop(loss_tracks(spark, folder), "user_id", "epoch", "loss", PATIENCE)
    return ends.select(
        "user_id", F.col("stop_epoch").cast("string").alias("stop_epoch"),
        F.col("kept_epoch").cast("string").alias("kept_epoch"), rounded("last_loss"), "stopped",
    )


def percent_format(spark: SparkSession, folder: str) -> DataFrame:
    """Average relative score per method as text with three decimals of a percentage."""
    relative = report.relative_scores(best_scores(spark, folder))
    means = relative.groupBy("section", "method").agg(F.avg("value").alias("value"))
    return means.select("section", "method", F.round(F.col("value") * 100.0, 3).alias("percent"))


QUERIES = {
    "replicate_mean": replicate_mean,
    "best_per_method": best_per_method,
    "benchmark_means": benchmark_means,
    "row_means": row_means,
    "imputation_score": imputation_score,
    "relative_score": relative_score,
    "method_table": method_table,
    "win_matrix": win_matrix,
    "grand_table": grand_table,
    "welch_t": welch_t,
    "paired_t": paired_t,
    "significance": significance,
    "best_row_per_group": best_row_per_group,
    "profile_join": profile_join,
    "display_names": display_names,
    "epoch_loss": epoch_losses,
    "early_stop_epoch": early_stop_epoch,
    "early_stop_delta": early_stop_delta,
    "percent_format": percent_format,
}

RUNS_SQL = """(SELECT n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS task,
  c_mktsegment AS method, c_custkey AS run, imputation_perf, kmeans_perf, knn_perf, predictor_perf
  FROM (SELECT o_custkey, max(o_totalprice) AS imputation_perf, avg(o_totalprice) AS kmeans_perf, min(o_totalprice) AS knn_perf,
      CAST(count(*) AS DOUBLE) AS predictor_perf FROM orders GROUP BY o_custkey)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

_BEST = f"""WITH runs AS {RUNS_SQL}, best AS (""" + " UNION ALL ".join(
    f"""SELECT '{s}' AS section, task, name, method,
    {f'max({m})' if s in report.GREATER_IS_BETTER else f"CASE WHEN task = 'classification' THEN max({m}) ELSE min({m}) END"} AS value
    FROM runs GROUP BY task, name, method""" for s, m in METRICS.items()
) + ")"

_RELATIVE = f"""{_BEST}, shares AS (SELECT section, task, name, method,
    (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) AS f FROM best
    WINDOW w AS (PARTITION BY section, task, name)),
  relative AS (SELECT section, task, name, method,
    CASE WHEN section NOT IN ('Imputation', 'Clustering') AND task = 'regression' THEN 1 - f ELSE f END AS value FROM shares)"""

_IN = ", ".join(f"'{b}'" for b in BASELINES)

_TRACKS = "(SELECT user_id, CAST(ts AS DATE) AS epoch, avg(value) AS loss FROM events GROUP BY 1, 2)"

ORACLES = {
    "replicate_mean": """SELECT lang, quality, round(avg(n_chars), 6) AS n_chars FROM documents d
        LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, quality""",
    "best_per_method": f"""SELECT 'Supervised learning' AS section, task, name, method,
        round(CASE WHEN task = 'classification' THEN max(knn_perf) * 100 ELSE min(knn_perf) END, 6) AS value FROM {RUNS_SQL} GROUP BY task, name, method""",
    "benchmark_means": f"SELECT 'benchmark' AS method, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS.values())} FROM {RUNS_SQL}",
    "row_means": """SELECT d.doc_id, round((n_chars + coalesce(quality, 0) + coalesce(toxic, 0)) / (1.0 + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT)::DOUBLE, 6) AS mean
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "imputation_score": f"""WITH runs AS {RUNS_SQL}, scaled AS (SELECT name, run,
        (predictor_perf - min(predictor_perf) OVER w) / nullif(max(predictor_perf) OVER w - min(predictor_perf) OVER w, 0) AS a,
        1 - (kmeans_perf - min(kmeans_perf) OVER w) / nullif(max(kmeans_perf) OVER w - min(kmeans_perf) OVER w, 0) AS b
        FROM runs WINDOW w AS (PARTITION BY name))
      SELECT name, run, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS score FROM scaled""",
    "relative_score": f"{_RELATIVE} SELECT section, task, name, method, round(value, 6) AS value FROM relative",
    "method_table": f"""{_BEST} SELECT task, name, {', '.join(f"round(max(CASE WHEN method = '{m}' THEN value END), 6) AS {m}" for m in METHODS)}
        FROM best WHERE section = 'Clustering' GROUP BY task, name""",
    "win_matrix": f"""{_RELATIVE} SELECT a.section, a.method AS winner, b.method AS loser,
        round(avg(CAST(a.value > b.value AS INTEGER)), 6) AS share, count(*) AS tables
        FROM relative a JOIN relative b ON a.section = b.section AND a.task = b.task AND a.name = b.name AND a.method <> b.method
        WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.section, a.method, b.method""",
    "grand_table": f"""{_RELATIVE} SELECT method, {', '.join(f"round(avg(CASE WHEN section = '{s}' THEN value END), 6) AS {s.split()[0].lower()}" for s in SECTIONS)}
        FROM relative GROUP BY method""",
    "welch_t": f"""{_RELATIVE}, m AS (SELECT section,
          avg(CASE WHEN method = '{OWN}' THEN value END) AS ma, var_samp(CASE WHEN method = '{OWN}' THEN value END) AS va, count(CASE WHEN method = '{OWN}' THEN value END) AS na,
          avg(CASE WHEN method IN ({_IN}) THEN value END) AS mb, var_samp(CASE WHEN method IN ({_IN}) THEN value END) AS vb, count(CASE WHEN method IN ({_IN}) THEN value END) AS nb
        FROM relative GROUP BY section)
        SELECT section, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t,
          round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 6) AS df FROM m""",
    "paired_t": f"""{_RELATIVE} SELECT a.section, b.method AS baseline,
          round(avg(a.value - b.value) * sqrt(count(*)) / stddev_samp(a.value - b.value), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df
        FROM relative a JOIN relative b ON a.section = b.section AND a.task = b.task AND a.name = b.name
        WHERE a.method = '{OWN}' AND b.method IN ({_IN}) AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.section, b.method""",
    "best_row_per_group": f"""SELECT method, name, task, run, round(imputation_perf, 6) AS imputation_perf FROM {RUNS_SQL}
        QUALIFY row_number() OVER (PARTITION BY method ORDER BY imputation_perf DESC, run) = 1""",
    "profile_join": f"""SELECT n_name AS name, n_regionkey AS samples, best FROM nation
        JOIN (SELECT name, round(max(kmeans_perf), 6) AS best FROM {RUNS_SQL} GROUP BY name) ON n_name = name""",
    "display_names": f"""SELECT CASE method WHEN 'AUTOMOBILE' THEN 'Autos' WHEN 'BUILDING' THEN 'Builders' WHEN 'FURNITURE' THEN 'Furnishers' END AS method,
        count(*) AS runs FROM {RUNS_SQL} GROUP BY 1""",
    "epoch_loss": f"SELECT user_id, CAST(epoch AS VARCHAR) AS epoch, round(loss, 6) AS loss FROM {_TRACKS}",
    "early_stop_epoch": f"""WITH RECURSIVE track AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS i FROM {_TRACKS}),
      walk AS (SELECT user_id, i, epoch, loss, loss AS best, epoch AS best_epoch, 0 AS waiting FROM track WHERE i = 1
        UNION ALL SELECT t.user_id, t.i, t.epoch, t.loss, least(w.best, t.loss),
          CASE WHEN t.loss <= w.best THEN t.epoch ELSE w.best_epoch END, CASE WHEN t.loss <= w.best THEN 0 ELSE w.waiting + 1 END
        FROM walk w JOIN track t ON t.user_id = w.user_id AND t.i = w.i + 1 WHERE w.waiting < {PATIENCE})
      SELECT user_id, CAST(epoch AS VARCHAR) AS stop_epoch, CAST(CASE WHEN waiting >= {PATIENCE} THEN best_epoch ELSE epoch END AS VARCHAR) AS kept_epoch,
        round(loss, 6) AS last_loss, waiting >= {PATIENCE} AS stopped
      FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "early_stop_delta": f"""WITH RECURSIVE track AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS i FROM {_TRACKS}),
      walk AS (SELECT user_id, i, epoch, loss, loss AS best, epoch AS best_epoch, 0 AS waiting FROM track WHERE i = 1
        UNION ALL SELECT t.user_id, t.i, t.epoch, t.loss, CASE WHEN -t.loss >= -w.best + {DELTA} THEN t.loss ELSE w.best END,
          CASE WHEN -t.loss >= -w.best + {DELTA} THEN t.epoch ELSE w.best_epoch END,
          CASE WHEN -t.loss >= -w.best + {DELTA} THEN 0 ELSE w.waiting + 1 END
        FROM walk w JOIN track t ON t.user_id = w.user_id AND t.i = w.i + 1 WHERE w.waiting < {PATIENCE})
      SELECT user_id, CAST(epoch AS VARCHAR) AS stop_epoch, CAST(CASE WHEN waiting >= {PATIENCE} THEN best_epoch ELSE epoch END AS VARCHAR) AS kept_epoch,
        round(loss, 6) AS last_loss, waiting >= {PATIENCE} AS stopped
      FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "significance": f"""{_RELATIVE}, m AS (SELECT section,
          avg(CASE WHEN method = '{OWN}' THEN value END) AS ma, var_samp(CASE WHEN method = '{OWN}' THEN value END) AS va, count(CASE WHEN method = '{OWN}' THEN value END) AS na,
          avg(CASE WHEN method IN ({_IN}) THEN value END) AS mb, var_samp(CASE WHEN method IN ({_IN}) THEN value END) AS vb, count(CASE WHEN method IN ({_IN}) THEN value END) AS nb
        FROM relative GROUP BY section),
      tests AS (SELECT section, 'all' AS baseline, (ma - mb) / sqrt(va / na + vb / nb) AS t,
          pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM m
        UNION ALL SELECT a.section, b.method, avg(a.value - b.value) * sqrt(count(*)) / stddev_samp(a.value - b.value), CAST(count(*) - 1 AS DOUBLE)
        FROM relative a JOIN relative b ON a.section = b.section AND a.task = b.task AND a.name = b.name
        WHERE a.method = '{OWN}' AND b.method IN ({_IN}) AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.section, b.method),
      steps AS (SELECT section, baseline, t, df, atan(t / sqrt(df)) / {PANELS} AS h, unnest(range({PANELS} + 1)) AS i FROM tests),
      areas AS (SELECT section, baseline, t, df, sum(CASE WHEN i IN (0, {PANELS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i * h), df - 1)) * h / 3 AS area
        FROM steps GROUP BY section, baseline, t, df, h)
      SELECT section, baseline, round(t, 6) AS t, round(df, 6) AS df,
        round(0.5 - exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * area, 6) AS p FROM areas""",
    "percent_format": f"{_RELATIVE} SELECT section, method, round(avg(value) * 100.0, 3) AS percent FROM relative GROUP BY section, method",
}
