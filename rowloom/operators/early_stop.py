"""Early stopping over recorded loss tracks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stop(tracks: DataFrame, run: str, epoch: str, loss: str, patience: int = 5, delta: float = 0.0) -> DataFrame:
    """Per run: epochs run, the epoch whose weights are kept, the last loss seen, and whether it stopped early.

    An epoch improves when its loss is no worse than the best so far minus ``delta``; ``patience`` epochs
    without improvement stop the run and the best epoch is kept. A run that never stops keeps its last epoch.
    Result: (run, stop_epoch, kept_epoch, last_loss, stopped).
    """
    if delta != 0.0:
        return _early_stop_with_delta(tracks, run, epoch, loss, patience, delta)
    ordered = Window.partitionBy(run).orderBy(epoch)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    improved = F.coalesce(F.col(loss) <= F.min(loss).over(earlier), F.lit(True))
    steps = (
        tracks.select(run, epoch, loss)
        .withColumn("_i", F.row_number().over(ordered))
        .withColumn("_better", improved)
        .withColumn("_waiting", F.col("_i") - F.max(F.when(F.col("_better"), F.col("_i"))).over(ordered))
        .withColumn("_best", F.last(F.when(F.col("_better"), F.col(epoch)), ignorenulls=True).over(ordered))
    )
    here = F.struct(epoch, loss, "_best")
    ends = steps.groupBy(run).agg(
        F.min(F.when(F.col("_waiting") >= patience, here)).alias("stop"), F.max(here).alias("end")
    )
    stopped = F.col("stop").isNotNull()
    return ends.select(
        run,
        F.when(stopped, F.col(f"stop.{epoch}")).otherwise(F.col(f"end.{epoch}")).alias("stop_epoch"),
        F.when(stopped, F.col("stop._best")).otherwise(F.col(f"end.{epoch}")).alias("kept_epoch"),
        F.when(stopped, F.col(f"stop.{loss}")).otherwise(F.col(f"end.{loss}")).alias("last_loss"),
        stopped.alias("stopped"),
    )


def _early_stop_with_delta(tracks: DataFrame, run: str, epoch: str, loss: str, patience: int, delta: float) -> DataFrame:
    """The best score depends on which epochs counted as better, so each run's short track is walked in order."""
    run_type, epoch_type = (tracks.schema[c].dataType.simpleString() for c in (run, epoch))

    def walk(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values(epoch)
        best, best_epoch, waiting, stopped = None, None, 0, False
        for e, value in zip(track[epoch], track[loss]):
            if best is None or -value >= best + delta:
                best, best_epoch, waiting = -value, e, 0
            else:
                waiting += 1
                stopped = waiting >= patience
            if stopped:
                break
        return pd.DataFrame({run: [track[run].iloc[0]], "stop_epoch": [e], "kept_epoch": [best_epoch if stopped else e],
                             "last_loss": [value], "stopped": [stopped]})

    schema = f"{run} {run_type}, stop_epoch {epoch_type}, kept_epoch {epoch_type}, last_loss double, stopped boolean"
    return tracks.groupBy(run).applyInPandas(walk, schema)
