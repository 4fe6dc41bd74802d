"""Datacards: which columns of a table are text, dense, categorical or numeric, and which is the response."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from fnmatch import fnmatchcase
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REST = "*"  # a list entry with a star is a name pattern; a lone star takes every column left over


@dataclass(frozen=True)
class DataCard:
    """Logical schema of a table.

    ``key`` is the unique row key; it drives splits, batches and tie-breaks. ``bind`` replaces name patterns
    by the columns they match and ``REST`` by the columns left over. ``levels`` is one number for all
    categorical variables, or a list in the order of ``cat``, or a mapping.
    """

    key: str
    dense: list[str] = field(default_factory=list)
    txt: list[str] = field(default_factory=list)
    cat: list[str] = field(default_factory=list)
    num: list[str] = field(default_factory=list)
    response: str | None = None
    levels: Any = None

    def __post_init__(self) -> None:
        levels = self.levels
        if isinstance(levels, int):
            if not any("*" in v for v in self.cat):
                levels = dict.fromkeys(self.cat, levels)
        elif isinstance(levels, (list, tuple)):
            if len(levels) != len(self.cat):
                raise ValueError(f"{len(levels)} level counts for {len(self.cat)} categorical variables")
            levels = dict(zip(self.cat, levels))
        elif levels is not None and set(levels) != set(self.cat):
            raise ValueError("level counts do not name the categorical variables")
        object.__setattr__(self, "levels", levels)

    @property
    def variables(self) -> list[str]:
        """Every variable, in the order dense, text, categorical, numeric."""
        return [*self.dense, *self.txt, *self.cat, *self.num]

    @property
    def features(self) -> list[str]:
        return [v for v in self.variables if v != self.response]

    @property
    def cat_features(self) -> list[str]:
        return [v for v in self.cat if v != self.response]

    @property
    def num_features(self) -> list[str]:
        return [v for v in self.num if v != self.response]

    @property
    def task(self) -> str | None:
        if self.response is None:
            return None
        return "classification" if self.response in self.cat else "regression"

    def counts(self) -> dict[str, int]:
        return {"num": len(self.num), "cat": len(self.cat), "txt": len(self.txt), "dense": len(self.dense)}

    def with_levels(self, levels: dict[str, int]) -> "DataCard":
        return replace(self, levels=levels)

    def bind(self, df: DataFrame) -> "DataCard":
        """Resolve patterns against the columns of ``df`` and check that all named columns exist."""
        kinds = {"dense": self.dense, "txt": self.txt, "cat": self.cat, "num": self.num}
        taken = {v for names in kinds.values() for v in names if "*" not in v} | {self.key, "split"}
        resolved: dict[str, list[str]] = {kind: [v for v in names if "*" not in v] for kind, names in kinds.items()}
        patterns = [(kind, v) for kind, names in kinds.items() for v in names if "*" in v]
        for kind, pattern in sorted(patterns, key=lambda p: p[1] == REST):
            found = [c for c in df.columns if c not in taken and fnmatchcase(c, pattern)]
            resolved[kind] += found
            taken.update(found)
        kinds = resolved
        card = replace(self, **kinds, levels=self.levels)
        wanted = [card.key, *card.variables] + ([card.response] if card.response else [])
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing from the table: {missing}")
        if card.response and card.response not in card.variables:
            raise ValueError(f"response {card.response} is not among the card's variables")
        return card

    def select(self, df: DataFrame, *extra: str) -> DataFrame:
        """Key, extra columns and the card's variables, nothing else."""
        return df.select(self.key, *extra, *[F.col(f"`{v}`") for v in self.variables])

    def features_of(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, *[F.col(f"`{v}`") for v in self.features])

    def response_of(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, F.col(f"`{self.response}`"))


def read_cards(path: str | Path) -> dict[str, dict]:
    """Read a mapping ``name -> card fields`` from a JSON or YAML file."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the yaml package; use JSON instead") from error
    return yaml.safe_load(text)


def card_from_fields(key: str, fields: dict) -> DataCard:
    """Build a card from the field names of the published card files (``img_vars``, ``txt_vars``, ...)."""
    return DataCard(
        key=key,
        dense=list(fields.get("img_vars", [])),
        txt=list(fields.get("txt_vars", [])),
        cat=list(fields.get("cat_vars", [])),
        num=list(fields.get("num_vars", [])),
        response=fields.get("response"),
        levels=fields.get("cat_levels"),
    )


def level_check(df: DataFrame, card: DataCard) -> DataFrame:
    """One row per categorical variable: greatest code, declared level count, and whether the code fits."""
    greatest = df.agg(*[F.max(F.col(f"`{v}`")).cast("long").alias(v) for v in card.cat])
    pairs: list[Column] = [
        F.struct(
            F.lit(v).alias("variable"),
            F.col(f"`{v}`").alias("max_code"),
            F.lit(int(card.levels[v])).cast("long").alias("levels"),
        )
        for v in card.cat
    ]
    return (
        greatest.select(F.inline(F.array(*pairs)))
        .withColumn("fits", F.col("max_code") < F.col("levels"))
    )


def column_levels(df: DataFrame, variables: list[str]) -> DataFrame:
    """Number of distinct non-null values of each listed column, in one scan."""
    counted = df.agg(*[F.count_distinct(F.col(f"`{v}`")).alias(v) for v in variables])
    pairs = [F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").alias("levels")) for v in variables]
    return counted.select(F.inline(F.array(*pairs)))


def profile(df: DataFrame, card: DataCard, name: str) -> DataFrame:
    """Sample count and variable counts per kind; ``variables`` is their sum."""
    counts = card.counts()
    return df.agg(F.count(F.lit(1)).alias("samples")).select(
        F.lit(name).alias("name"),
        F.lit(card.task).cast(T.StringType()).alias("task"),
        "samples",
        *[F.lit(n).cast("long").alias(f"{kind}_variables") for kind, n in counts.items()],
        F.lit(sum(counts.values())).cast("long").alias("variables"),
    )
