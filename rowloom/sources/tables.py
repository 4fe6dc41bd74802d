"""Readers for single tables and pre-split tables, and the registry that names them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowloom.cards import DataCard
from rowloom.operators.columns import nan_to_null, union_named
from rowloom.operators.sampling import with_split
from rowloom.plans.recipe import FittedRecipe, Recipe

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, format: str | None = None) -> DataFrame:
    """One table from a file or folder; the format comes from the suffix, Parquet where there is none."""
    kind = format or FORMATS.get(PurePosixPath(path).suffix, "parquet")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: StructType | str | None = None) -> DataFrame:
    """A pre-split table as one DataFrame with a ``split`` column."""
    return union_named({name: read_table(spark, path, schema) for name, path in paths.items()}, "split")


@dataclass(frozen=True)
class Dataset:
    """A registered table: its card, its preparation steps, whether it arrives already split, and where it
    was published."""

    card: DataCard
    recipe: Recipe = Recipe()
    presplit: bool = False
    origin: str = ""

    def prepare(self, raw: DataFrame, seed: int | None = None) -> tuple[DataFrame, DataCard, FittedRecipe]:
        """Apply the recipe, add the split where the table has none, and bind the card."""
        if self.card.key not in raw.columns:
            raise ValueError(f"the table needs a unique key column {self.card.key!r}; see with_row_key")
        raw = nan_to_null(raw)
        fitted = self.recipe.fit(raw)
        df = fitted.transform(raw)
        card = self.card.bind(df)
        if not self.presplit:
            df = with_split(df, card.key, seed)
        return card.select(df, "split"), card, fitted


def with_row_key(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Unique row numbers for a table that has no key. Write the result before using it: the numbers follow
    the partitions of this read."""
    return df.withColumn(name, F.monotonically_increasing_id())


class Registry:
    """Named datasets; an unknown name raises with the list of names."""

    def __init__(self, entries: dict[str, Dataset]):
        self.entries = dict(entries)

    def __getitem__(self, name: str) -> Dataset:
        try:
            return self.entries[name]
        except KeyError:
            raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(self.entries))}") from None

    def __iter__(self):
        return iter(self.entries)

    def __len__(self) -> int:
        return len(self.entries)

    def register(self, name: str, dataset: Dataset) -> None:
        self.entries[name] = dataset

    def load(self, spark: SparkSession, name: str, locate: Callable[[str], str | dict[str, str]], seed: int | None = None):
        """Read and prepare a dataset; ``locate(name)`` gives its path, or one path per split."""
        dataset = self[name]
        where = locate(name)
        raw = read_splits(spark, where) if isinstance(where, dict) else read_table(spark, where)
        return dataset.prepare(raw, seed)
