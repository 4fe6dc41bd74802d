"""Category codes, one-hot vectors and feature assembly."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.lookup import ROW_BYTES, lookup_join
from rowloom.operators.sampling import compact
from rowloom.session import ensure_checkpoint_dir

MAX_DENSE_LEVELS = 4096
#: Level tables with more rows are ranked by ranges instead of one window a variable.
MAX_WINDOW_ROWS = 1_000_000


def levels_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null levels of all listed columns with their row counts, in one scan: (variable, level, n)."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns]
    )
    return (
        df.select(F.inline(cells))
        .filter(F.col("level").isNotNull())
        .groupBy("variable", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def level_order(order: str) -> list[Column]:
    if order == "numeric":
        return [F.col("level").try_cast("double"), F.col("level")]
    if order == "lexical":
        return [F.col("level")]
    raise ValueError("order is 'lexical' or 'numeric'")


def rank_levels(levels: DataFrame, order: str = "lexical", max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """Add ``code``: the position of the level among the sorted levels of its variable, from 0.

    Level tables up to the bound are ranked by a window per variable. Larger ones are range-partitioned,
    materialised, ranked inside each range and shifted by the sizes of the ranges before.
    """
    keys = level_order(order)
    if levels.count() <= max_window_rows:
        return levels.withColumn("code", F.row_number().over(Window.partitionBy("variable").orderBy(*keys)) - 1)
    ensure_checkpoint_dir(levels.sparkSession)
    ranged = (
        levels.repartitionByRange(F.col("variable"), *keys)
        .withColumn("_range", F.spark_partition_id())
        .checkpoint()
    )
    sizes = ranged.groupBy("variable", "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("variable").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("variable", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("variable", "_range").orderBy(*keys)
    return (
        ranged.withColumn("_row", F.row_number().over(inside) - 1)
        .join(shifts, ["variable", "_range"])
        .withColumn("code", (F.col("_row") + F.col("_shift")).cast("int"))
        .drop("_range", "_row", "_shift")
    )


@dataclass
class LevelCodes:
    """Codes of categorical columns, fitted on the whole table or on train rows.

    ``unseen`` decides about levels without a code: ``error`` raises when such a row is read, ``skip`` drops
    the row, ``keep`` gives the code after the last one, ``null`` leaves null. With ``null_level`` null is a level
    too, the last one, where the fitted rows have it; otherwise it is a level without a code.
    """

    columns: list[str]
    table: DataFrame
    sizes: dict[str, int]
    unseen: str = "error"
    nulls: dict[str, int] = field(default_factory=dict)
    bytes: dict[str, int] = field(default_factory=dict)

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: list[str],
        order: str = "lexical",
        train_only: bool = False,
        unseen: str = "error",
        null_level: bool = False,
    ) -> "LevelCodes":
        if unseen not in ("error", "skip", "keep", "null"):
            raise ValueError("unseen is 'error', 'skip', 'keep' or 'null'")
        if train_only:
            df = df.filter(F.col("split") == "train")
        table = compact(rank_levels(compact(levels_of(df, columns)), order))
        levels = F.sum(F.octet_length("level") + 2 * ROW_BYTES).alias("bytes")
        counted = {r["variable"]: r for r in table.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), levels).collect()}
        sizes, nulls = {c: counted[c]["n"] if c in counted else 0 for c in columns}, {}
        held = {c: counted[c]["bytes"] if c in counted else 0 for c in columns}
        if null_level and columns:
            present = df.agg(*[F.coalesce(F.max(F.col(f"`{c}`").isNull()), F.lit(False)).alias(c) for c in columns]).first()
            nulls = {c: sizes[c] for c in columns if present[c]}
            sizes |= {c: n + 1 for c, n in nulls.items()}
        return cls(columns, table, sizes, unseen, nulls, held)

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        for name in self.columns:
            codes = self.table.filter(F.col("variable") == name).select(
                F.col("level").alias("_level"), F.col("code").cast("long").alias("_code")
            )
            present = F.col(f"`{name}`").cast("string")
            df = lookup_join(df.withColumn("_level", present), codes, ["_level"], size=self.bytes.get(name))
            if name in self.nulls:
                df = df.withColumn("_code", F.when(F.col("_level").isNull(), F.lit(self.nulls[name]).cast("long")).otherwise(F.col("_code")))
            if self.unseen == "skip":
                df = df.filter(F.col("_code").isNotNull())
            code = F.col("_code")
            if self.unseen == "keep":
                code = F.coalesce(code, F.lit(self.sizes[name]).cast("long"))
            elif self.unseen == "error":
                message = F.concat(F.lit(f"level of {name} without a code: "), F.coalesce("_level", F.lit("null")))
                code = F.when(code.isNull(), F.raise_error(message).cast("long")).otherwise(code)
            df = df.withColumn(name, code).drop("_level", "_code")
        return df.select(*[F.col(f"`{c}`") for c in order])


def one_hot(column: Column, levels: list, unseen: str = "ignore") -> Column:
    """Indicator vector over the given levels; all zeros (or an error) for a value outside them."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in levels]), column), F.lit(0)).cast("int")
    zeros = F.array_repeat(F.lit(0.0), len(levels))
    hot = F.concat(F.array_repeat(F.lit(0.0), at - 1), F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), F.lit(len(levels)) - at))
    vector = F.when(at > 0, hot).otherwise(zeros)
    if unseen == "error":
        return F.when(at > 0, hot).otherwise(
            F.raise_error(F.concat(F.lit("value outside the levels: "), column.cast("string"))).cast("array<double>")
        )
    return vector


@dataclass(frozen=True)
class OneHot:
    """Dense one-hot encoding with levels fitted on train; encoded columns first, other columns after."""

    levels: dict[str, list[str]]
    passthrough: list[str]
    unseen: str = "ignore"

    @classmethod
    def fit(cls, df: DataFrame, cat: list[str], num: list[str], train_only: bool = True, unseen: str = "ignore") -> "OneHot":
        levels: dict[str, list[str]] = {c: [] for c in cat}
        if cat:
            if train_only:
                df = df.filter(F.col("split") == "train")
            found = levels_of(df, cat).limit(MAX_DENSE_LEVELS + 1).collect()
            if len(found) > MAX_DENSE_LEVELS:
                raise ValueError(f"more than {MAX_DENSE_LEVELS} levels: use one_hot_sparse")
            for row in found:
                levels[row["variable"]].append(row["level"])
        return cls({c: sorted(v) for c, v in levels.items()}, list(num), unseen)

    @property
    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.levels.items() for v in values] + self.passthrough

    def blocks(self) -> list[Column]:
        encoded = [
            one_hot(F.col(f"`{c}`").cast("string"), values, self.unseen) for c, values in self.levels.items() if values
        ]
        if self.passthrough:
            encoded.append(F.array(*[F.col(f"`{c}`").cast("double") for c in self.passthrough]))
        return encoded

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        return df.withColumn(output, F.concat(*self.blocks()))


def one_hot_sparse(df: DataFrame, cat: list[str], num: list[str], output: str = "features", missing: str = "zero") -> DataFrame:
    """Sparse vectors for wide level sets, fitted on train rows; unseen and null levels become all zeros.

    Levels stay in a table; only their number reaches the driver. ``missing`` decides about null numbers: ``zero``
    fills them, ``drop`` leaves their rows out.
    """
    if missing not in ("zero", "drop"):
        raise ValueError("missing is 'zero' or 'drop'")
    indexed, coded, filled = ([f"_{kind}_{i}" for i in range(len(names))] for kind, names in (("i", cat), ("v", cat), ("n", num)))
    if missing == "drop" and num:
        df = df.dropna(subset=[f"`{c}`" for c in num])
    work = df.withColumns({n: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for n, c in zip(filled, num)}) if num else df
    if cat:
        work = work.withColumns({i: F.col(f"`{c}`") for i, c in zip(indexed, cat)})
        fitted = LevelCodes.fit(work, indexed, order="lexical", train_only=True, unseen="keep")
        # one value more than there are levels: the code of unseen ones, which the encoder drops
        sizes = {i: {"ml_attr": {"type": "nominal", "num_vals": fitted.sizes[i] + 1}} for i in indexed}
        work = fitted.transform(work)
        work = work.withColumns({i: F.col(i).cast("double") for i in indexed})
        for i in indexed:
            work = work.withMetadata(i, sizes[i])
        work = OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True).fit(work).transform(work)
    return VectorAssembler(inputCols=[*coded, *filled], outputCol=output).transform(work).drop(*indexed, *coded, *filled)
