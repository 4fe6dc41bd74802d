"""Renames, casts, null filters and named unions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"cannot rename missing columns: {sorted(missing)}")
    return df.withColumnsRenamed(names)


def sanitize_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores; two names may not become one."""
    names = [c.replace(".", "_") for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("two columns would share a name after sanitizing")
    return df.toDF(*names)


def cast(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Cast listed columns; ``strict=False`` turns values that do not fit into null."""
    def change(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        return column.cast(kind) if strict else column.try_cast(kind)

    return df.withColumns({name: change(name, kind) for name, kind in types.items()})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, so that aggregates skip it."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in floating})


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return reduce(lambda d, c: d.filter(F.col(f"`{c}`").isNotNull()), columns, df)


def log10(df: DataFrame, *columns: str) -> DataFrame:
    """Base-10 logarithm; null where the value is not positive."""
    return df.withColumns({c: F.log10(F.col(f"`{c}`").cast("double")) for c in columns})


def log1p(df: DataFrame, *columns: str) -> DataFrame:
    """log(1 + x); null where x <= -1."""
    return df.withColumns({c: F.log1p(F.col(f"`{c}`").cast("double")) for c in columns})


def apply_functions(df: DataFrame, functions: dict) -> DataFrame:
    """Replace each named column by ``function(Column)``."""
    return df.withColumns({c: f(F.col(f"`{c}`")) for c, f in functions.items()})


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a frame-to-frame function to batches of rows, lazily; for what no expression can say."""
    return df.mapInPandas(lambda frames: map(function, frames), schema)


def union_named(tables: dict[str, DataFrame], label: str) -> DataFrame:
    """Stack tables with different columns; the table's name goes to column ``label``."""
    labelled = [df.withColumn(label, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
