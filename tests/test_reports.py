import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.cards import DataCard
from rowloom.functions.stats import regularized_beta, student_upper_tail
from rowloom.operators import report
from rowloom.operators.early_stop import early_stop
from rowloom.plans.summary import summarize
from rowloom.sources.grids import BLOBS, LARGEST, STANDARD, RunGrid, grid_of
from rowloom.sources.results import RESULT_SCHEMA, append_results, export_csv, read_results


def test_student_tail_matches_tables():
    assert student_upper_tail(1.812461, 10) == pytest.approx(0.05, abs=1e-6)
    assert student_upper_tail(2.0, 1) == pytest.approx(0.5 - math.atan(2.0) / math.pi)
    assert student_upper_tail(-1.0, 5) == pytest.approx(1 - student_upper_tail(1.0, 5))
    assert student_upper_tail(1.959964, 1e7) == pytest.approx(0.025, abs=1e-6)
    assert regularized_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)
    assert math.isnan(student_upper_tail(float("nan"), 3))


@pytest.fixture()
def scores(spark):
    rng = np.random.default_rng(0)
    rows = []
    for section in ("Imputation", "Supervised learning"):
        for i in range(12):
            task = "classification" if i % 2 else "regression"
            for m in "ABC":
                if not (m == "C" and i in (0, 5)):
                    rows.append((section, task, f"t{i}", m, float(rng.integers(0, 9))))
    return pd.DataFrame(rows, columns=["section", "task", "name", "method", "value"])


def relative_by_hand(scores):
    def one(g):
        low, high = g.value.min(), g.value.max()
        f = (g.value - low) / (high - low) if high > low else g.value * np.nan
        reverse = (g.section.iloc[0] == "Supervised learning") and g.task.iloc[0] == "regression"
        return g.assign(value=1 - f if reverse else f)

    return pd.concat([one(g) for _, g in scores.groupby(["section", "task", "name"])])


def test_relative_wins_and_tests(spark, scores):
    relative = report.relative_scores(spark.createDataFrame(scores))
    hand = relative_by_hand(scores)
    got = relative.toPandas().sort_values(["section", "name", "method"]).value.to_numpy(float)
    assert np.allclose(got, hand.sort_values(["section", "name", "method"]).value.to_numpy(float), equal_nan=True)
    wins = {(r.section, r.winner, r.loser): r["share"] for r in report.win_rates(relative).collect()}
    wide = hand.pivot_table(index=["section", "name"], columns="method", values="value")
    for s in ("Imputation", "Supervised learning"):
        pair = wide.loc[s][["A", "C"]].dropna()
        assert wins[s, "A", "C"] == pytest.approx((pair.A > pair.C).mean())
        assert wins[s, "A", "C"] + wins[s, "C", "A"] <= 1.0
    welch = {r.section: r for r in report.welch_test(relative, "A", ["B", "C"]).collect()}
    paired = {(r.section, r.baseline): r for r in report.paired_test(relative, "A", ["B", "C"]).collect()}
    for s in wide.index.get_level_values(0).unique():
        a = hand[(hand.section == s) & (hand.method == "A")].value.dropna()
        b = hand[(hand.section == s) & (hand.method != "A")].value.dropna()
        t = (a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b))
        assert welch[s].t == pytest.approx(t) and 0 < welch[s].p < 1
        gap = (wide.loc[s].A - wide.loc[s].C).dropna()
        assert paired[s, "C"].t == pytest.approx(gap.mean() / gap.std() * math.sqrt(len(gap)))
        assert paired[s, "C"].df == len(gap) - 1


def test_grand_table_order_and_missing(spark, scores):
    relative = report.relative_scores(spark.createDataFrame(scores[~((scores.section == "Imputation") & (scores.method == "B"))]))
    table = report.grand_table(relative, ["Imputation", "Supervised learning"], ["C", "B", "A"]).collect()
    assert [r.method for r in table] == ["C", "B", "A"] and table[1]["Imputation"] is None


def test_replicate_mean_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, 3.0), (1, 5, 7.0)], "a int, b int, v double")
    assert {(r.a, r.b): r.v for r in report.replicate_mean(df, ["a", "b"], ["v"]).collect()} == {(1, None): 2.0, (1, 5): 7.0}


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(report.row_mean(["a", "b"])).collect()] == [1.0, None]


def test_best_row_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("m", 3, 0.9), ("m", 1, 0.9), ("m", 2, 0.1), ("n", 4, 0.2)], "method string, run int, score double")
    assert {r.method: r.run for r in report.best_row_per_group(df, "method", "score", "run").collect()} == {"m": 1, "n": 4}


TRACKS = {
    1: [5.0, 4.0, 4.5, 4.4, 4.3, 1.0],  # stops after three epochs without a better loss
    2: [5.0, 4.0, 3.0, 2.0, 1.0, 0.5],  # never stops
    3: [5.0, 5.0, 5.0, 5.0, 5.0, 5.0],  # ties count as better
    4: [1.0, 2.0, 3.0, 0.5, 9.0, 9.0],  # better just in time
}


@pytest.mark.parametrize("delta", [0.0, 1e-12])
def test_early_stop(spark, delta):
    rows = [(run, e, v) for run, track in TRACKS.items() for e, v in enumerate(track)]
    df = spark.createDataFrame(rows, "run int, epoch int, loss double")
    ends = {r.run: (r.stop_epoch, r.kept_epoch, r.last_loss, r.stopped) for r in early_stop(df, "run", "epoch", "loss", 3, delta).collect()}
    assert ends[1] == (4, 1, 4.3, True) and ends[2] == (5, 5, 0.5, False) and ends[4] == (5, 5, 9.0, False)
    assert ends[3] == ((5, 5, 5.0, False) if delta == 0.0 else (3, 0, 5.0, True))


def test_grids():
    assert len(STANDARD) == 5 * 11 * 3 * 7 and len(BLOBS) == 5 * 3 * 8 * 3 * 4
    assert LARGEST.learning_rates[1] == pytest.approx(0.0001778279410038)
    assert grid_of("abalone") is STANDARD and grid_of("skin_cancer").batch_sizes == (512,)


def test_grid_table(spark):
    grid = RunGrid((16,), (0.1, 0.2), (2,), ("CLIP", "MCN"), replicates=3)
    assert grid.table(spark).distinct().count() == 12


def test_results_are_replaced_per_run(spark, tmp_path):
    path = str(tmp_path / "results")

    def row(run, score):
        return ("d", run, 0, 16, 0.1, 2, "CLIP", 5, 1.0, 1.0, 0.1, score, 5, 1.0, 1.0, 0.5, {"x": 0.2})

    append_results(spark.createDataFrame([row("a", 0.1), row("b", 0.2)], RESULT_SCHEMA), path)
    append_results(spark.createDataFrame([row("b", 0.9)], RESULT_SCHEMA), path)
    assert {r.run_id: r.knn_perf for r in read_results(spark, path).collect()} == {"a": 0.1, "b": 0.9}
    export_csv(read_results(spark, path).select("run_id", "knn_perf"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_summary_from_files(spark, tmp_path):
    """Two small datasets, one without a benchmark file, through the whole chain."""
    base = pd.DataFrame({"batch_size": 8, "learning_rate": [0.1, 0.2, 0.1, 0.2], "latent_dim": 2, "model_type": ["CLIP", "CLIP", "ANCHOR", "CONTROL"],
                         "embedder_params": [5.0, 5.0, 6.0, np.nan], "predictor_params": 7.0, "kmeans_perf": [0.1, 0.3, 0.2, np.nan],
                         "knn_perf": [0.5, 0.4, 0.9, np.nan], "predictor_perf": [0.6, 0.7, 0.8, 0.1],
                         "k": [0.0, 0.5, 1.0, np.nan], "x": [4.0, 0.0, 2.0, np.nan]})
    base.to_csv(tmp_path / "one_experiment.csv")
    base.to_csv(tmp_path / "two_experiment.csv")
    pd.DataFrame({"replicate": [0.0, 1.0], "kmeans_perf": [0.0, 1.0], "knn_perf": [0.2, 0.4], "predictor_perf": [1.0, 0.0]}).to_csv(tmp_path / "one_benchmark.csv")
    cards = {"one": DataCard("id", cat=["k", "y"], num=["x"], response="y"), "two": DataCard("id", cat=["k"], num=["x", "y"], response="y"),
             "absent": DataCard("id", num=["y"], response="y")}
    display = {"CLIP": "Clip", "ANCHOR": "Anchor", "CONTROL": "Control", "benchmark": "Benchmark"}
    summary = summarize(spark, str(tmp_path), str(tmp_path), cards, display, ["Benchmark", "Control", "Clip", "Anchor"])
    best = {(r.section, r.name, r.method): r.value for r in summary.scores.collect()}
    assert best["Imputation", "one", "Clip"] == pytest.approx(0.75) and best["Imputation", "one", "Anchor"] == pytest.approx(0.75)
    assert best["Supervised learning", "one", "Clip"] == pytest.approx(50.0) and best["Supervised learning", "two", "Clip"] == pytest.approx(0.4)
    assert best["Clustering", "one", "Benchmark"] == pytest.approx(0.5) and ("Clustering", "two", "Benchmark") not in best
    grand = {r.method: r for r in summary.grand_table().collect()}
    assert grand["Anchor"]["Transfer learning"] == pytest.approx(0.5) and grand["Anchor"]["Imputation"] is None
    row = summary.section_table("Clustering").filter(F.col("name") == "two").first()
    assert row["Benchmark"] is None and row["Clip"] == pytest.approx(0.3)
