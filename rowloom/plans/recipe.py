"""Preprocessing recipes: an ordered list of declarative steps, fitted once and applied as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from rowloom.functions.text import clean_text
from rowloom.operators import columns as col_ops
from rowloom.operators.encoding import LevelCodes
from rowloom.operators.scaling import MinMax

NOT_VARIABLES = ("row_id", "split")  # left out where a step names all columns by a star
Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """One step; ``train_only`` applies to the steps that learn something (minmax, codes)."""

    action: str
    columns: tuple = ()
    options: dict = field(default_factory=dict)
    train_only: bool = False

    def bind(self, df: DataFrame) -> Transform:
        """Fit the step on ``df`` where it needs data and return its transform."""
        names = list(self.columns)
        if names == ["*"]:
            names = [c for c in df.columns if c not in NOT_VARIABLES]
        if self.action == "rename":
            return lambda d: col_ops.rename(d, self.options)
        if self.action == "sanitize":
            return col_ops.sanitize_names
        if self.action == "cast":
            return lambda d: col_ops.cast(d, self.options)
        if self.action == "not_null":
            return lambda d: col_ops.drop_missing(d, *names)
        if self.action == "log10":
            return lambda d: col_ops.log10(d, *names)
        if self.action == "log1p":
            return lambda d: col_ops.log1p(d, *names)
        if self.action == "clean":
            return lambda d: d.withColumns({c: clean_text(f"`{c}`", **self.options) for c in names})
        if self.action == "minmax":
            return MinMax.fit(df, names, self.train_only).transform
        if self.action == "codes":
            return LevelCodes.fit(df, names, train_only=self.train_only, **self.options).transform
        raise ValueError(f"unknown step {self.action}")


def rename(**names: str) -> Step:
    return Step("rename", options=names)


def rename_map(names: dict[str, str]) -> Step:
    return Step("rename", options=names)


def sanitize() -> Step:
    return Step("sanitize")


def cast(kind: str, *columns: str) -> Step:
    return Step("cast", options=dict.fromkeys(columns, kind))


def not_null(*columns: str) -> Step:
    return Step("not_null", columns)


def log10(*columns: str) -> Step:
    return Step("log10", columns)


def log1p(*columns: str) -> Step:
    return Step("log1p", columns)


def minmax(*columns: str, train_only: bool = False) -> Step:
    return Step("minmax", columns, train_only=train_only)


def codes(*columns: str, order: str = "numeric", train_only: bool = False, unseen: str = "error", null_level: bool = True) -> Step:
    return Step("codes", columns, {"order": order, "unseen": unseen, "null_level": null_level}, train_only)


def clean(*columns: str, max_words: int | None = None) -> Step:
    return Step("clean", columns, {"max_words": max_words})


@dataclass(frozen=True)
class FittedRecipe:
    transforms: tuple[Transform, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, t: t(d), self.transforms, df)


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...] = ()

    def fit(self, df: DataFrame) -> FittedRecipe:
        """Each step is fitted on the output of the steps before it."""
        transforms = []
        for step in self.steps:
            transforms.append(step.bind(df))
            df = transforms[-1](df)
        return FittedRecipe(tuple(transforms))

    def apply(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
