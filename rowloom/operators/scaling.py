"""Min-max scaling. ``fit`` is one aggregate over all columns; ``transform`` is a pure projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(column: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); 0 for a constant column."""
    return F.when(high > low, (column - low) / (high - low)).otherwise(column - low)


@dataclass(frozen=True)
class MinMax:
    """Fitted ranges per column. A column that had no value at fit time stays null."""

    ranges: dict[str, tuple[float | None, float | None]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], train_only: bool = False) -> "MinMax":
        """Ranges over the whole table, or over the rows with ``split = 'train'``."""
        if train_only:
            df = df.filter(F.col("split") == "train")
        measures = []
        for i, name in enumerate(columns):
            value = F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))
            measures += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}")]
        row = df.agg(*measures).first()
        return cls({name: (row[f"low{i}"], row[f"high{i}"]) for i, name in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.expression(name) for name in self.ranges})

    def expression(self, name: str) -> Column:
        low, high = (F.lit(bound).cast("double") for bound in self.ranges[name])
        return scaled(F.col(f"`{name}`").cast("double"), low, high)
