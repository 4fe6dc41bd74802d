"""From result files of many datasets to the comparison tables, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.cards import DataCard
from rowloom.operators import report
from rowloom.sources.results import METRICS, read_benchmarks, read_experiments, run_cells

SECTION_METRICS = {"Imputation": "imputation_perf", "Clustering": "kmeans_perf", "Supervised learning": "knn_perf", "Transfer learning": "predictor_perf"}


@dataclass
class Summary:
    """Best scores per section, table and method, and what follows from them."""

    scores: DataFrame
    methods: list[str]
    unranked: tuple[str, ...] = ("Benchmark", "Control")

    @property
    def wins(self) -> DataFrame:
        return report.win_rates(report.relative_scores(self.scores))

    @property
    def relative(self) -> DataFrame:
        """Relative scores among the trained embedders only."""
        return report.relative_scores(self.scores.filter(~F.col("method").isin(*self.unranked)))

    def grand_table(self) -> DataFrame:
        return report.grand_table(self.relative, list(SECTION_METRICS), [m for m in self.methods if m not in self.unranked])

    def section_table(self, section: str) -> DataFrame:
        return report.method_columns(self.scores.filter(F.col("section") == section), self.methods)

    def tests(self, method: str) -> tuple[DataFrame, DataFrame]:
        """(pooled, paired) one-sided tests of ``method`` against the other trained embedders."""
        rest = [m for m in self.methods if m not in self.unranked and m != method]
        return report.welch_test(self.relative, method, rest), report.paired_test(self.relative, method, rest)


def summarize(spark: SparkSession, runs_folder: str, benchmark_folder: str, cards: dict[str, DataCard],
              display: dict[str, str], methods: list[str]) -> Summary:
    """Read all run and benchmark files, score imputation, and take the best per table and method.

    ``display`` maps method codes of the files to display names; ``methods`` fixes their order.
    """
    tables = read_experiments(spark, runs_folder, list(cards))
    cells = reduce(lambda a, b: a.unionByName(b), [run_cells(t, n, cards[n]) for n, t in tables.items()])
    imputed = report.imputation_score(cells, ["run"]).withColumnRenamed("score", "imputation_perf")
    runs = reduce(
        lambda a, b: a.unionByName(b),
        [t.select(F.lit(n).alias("name"), "run", "model_type", *METRICS) for n, t in tables.items()],
    ).join(imputed, ["name", "run"], "left")
    benchmarks = read_benchmarks(spark, benchmark_folder, list(tables))
    everything = runs.drop("run").unionByName(benchmarks, allowMissingColumns=True)
    tasks = F.create_map(*[F.lit(x) for n, c in cards.items() for x in (n, c.task)])
    named = report.with_display_names(everything.withColumnRenamed("model_type", "method"), display)
    named = named.withColumn("task", F.element_at(tasks, F.col("name")))
    sections = [
        report.best_per_method(named, metric, section, percent=section not in report.GREATER_IS_BETTER)
        for section, metric in SECTION_METRICS.items()
    ]
    scores = reduce(lambda a, b: a.unionByName(b), sections).filter(F.col("value").isNotNull())
    return Summary(scores, methods)
