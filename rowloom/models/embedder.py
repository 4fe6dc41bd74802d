"""Embed, impute and predict: ``fit`` / ``transform`` pairs over datacards."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.cards import DataCard
from rowloom.functions.vectors import doubles, matrix, vector_array
from rowloom.models import networks
from rowloom.models.networks import Design, Variable
from rowloom.models.trainer import Settings, Trained, train
from rowloom.operators.encoding import LevelCodes
from rowloom.operators.metrics import balanced_accuracy, mse
from rowloom.operators.retrieval import first_best
from rowloom.operators.sampling import assign_batches
from rowloom.operators.scaling import MinMax
from rowloom.operators.words import COMPONENTS, TextComponents

MODEL_SCHEMA = "name string, shape array<int>, data array<double>"


@dataclass
class RowPacker:
    """Turns a card's columns into one ``packed`` vector and a numeric ``target``, fitted on train rows."""

    card: DataCard
    variables: tuple[Variable, ...]
    codes: LevelCodes | None
    ranges: MinMax
    texts: dict[str, TextComponents] = field(default_factory=dict)
    levels: dict[str, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, card: DataCard, text_width: int = COMPONENTS) -> "RowPacker":
        """Categories get codes (one more for unseen levels) unless the card declares level counts."""
        codes, levels = None, dict(card.levels or {})
        if card.cat and not levels:
            codes = LevelCodes.fit(df, card.cat, order="numeric", train_only=True, unseen="keep")
            levels = {v: n + 1 for v, n in codes.sizes.items()}
        ranges = MinMax.fit(df, card.num, train_only=True) if card.num else MinMax({})
        texts = {v: TextComponents.fit(df, card.key, v, text_width) for v in card.txt if v != card.response}
        widths = {}
        dense = [v for v in card.dense if v != card.response]
        if dense:
            row = df.agg(*[F.max(F.size(v)).alias(v) for v in dense]).first()
            widths = {v: int(row[v]) for v in dense}
        variables, at = [], 0
        for kind, names in (("dense", dense), ("txt", list(texts)), ("cat", card.cat_features), ("num", card.num_features)):
            for v in names:
                width = widths[v] if kind == "dense" else texts[v].width if kind == "txt" else 1
                variables.append(Variable(v, kind, at, width, levels.get(v, 0)))
                at += width
        return cls(card, tuple(variables), codes, ranges, texts, levels)

    @property
    def outputs(self) -> int:
        """Output width of a predictor of the response."""
        if self.card.response is None:
            raise ValueError("the card has no response")
        return self.levels[self.card.response] if self.card.task == "classification" else 1

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """(key, split, keep..., packed, target). Without text variables this is a chain of projections and lookups."""
        for v, text in self.texts.items():
            df = text.transform(df, self.card.key, v, f"_t_{v}")
        if self.codes:
            df = self.codes.transform(df)
        df = self.ranges.transform(df)
        blocks = []
        for v in self.variables:
            if v.kind == "dense":
                blocks.append(doubles(f"`{v.name}`"))
            elif v.kind == "txt":
                blocks.append(F.col(f"`_t_{v.name}`"))
            else:
                blocks.append(F.array(F.coalesce(F.col(f"`{v.name}`").cast("double"), F.lit(0.0))))
        response = self.card.response
        target = F.col(f"`{response}`").cast("double") if response else F.lit(None).cast("double")
        return df.select(self.card.key, "split", *keep, F.concat(*blocks).alias("packed"), target.alias("target"))


@dataclass
class TableEmbedder:
    """Contrastive row embeddings of a table. ``method`` is one of ``networks.METHODS``."""

    method: str = "ANCHOR"
    latent: int = 32
    hidden: int = 128
    phi: tuple[int, ...] = (128, 128)
    settings: Settings = Settings()

    def fit(self, df: DataFrame, card: DataCard, packer: RowPacker | None = None) -> "EmbedderModel":
        """``df`` has the card's columns and ``split``."""
        packer = packer or RowPacker.fit(df, card)
        return self.fit_packed(packer.transform(df), packer)

    def fit_packed(self, packed: DataFrame, packer: RowPacker) -> "EmbedderModel":
        design = Design(self.method, packer.variables, self.latent, self.hidden, tuple(self.phi),
                        networks.anchor_count(self.settings.batch_size))
        return EmbedderModel(packer, train(packed, packer.card.key, design, self.settings))


@dataclass
class EmbedderModel:
    packer: RowPacker
    trained: Trained

    @property
    def design(self) -> Design:
        return self.trained.design

    def transform(self, df: DataFrame) -> DataFrame:
        """(key, split, embedding, target)."""
        return self.transform_packed(self.packer.transform(df))

    def transform_packed(self, packed: DataFrame) -> DataFrame:
        design, shared = self.design, packed.sparkSession.sparkContext.broadcast(self.trained.weights)

        @F.arrow_udf("array<double>")
        def embed(rows: pa.Array) -> pa.Array:
            if not len(rows):
                return pa.array([], pa.list_(pa.float64()))
            return vector_array(networks.embed(design, shared.value, matrix(rows)))

        return packed.withColumn("embedding", embed("packed")).drop("packed")

    def impute_packed(self, packed: DataFrame, batch_size: int) -> DataFrame:
        """Every categorical and numeric feature of every row, chosen among the values of its batch by fit with
        the row's other features: (batch_id, key, variable, kind, truth, estimate)."""
        key, design = self.packer.card.key, self.design
        shared = packed.sparkSession.sparkContext.broadcast(self.trained.weights)
        asked = [v for v in design.variables if v.kind in ("cat", "num")]
        kind = packed.schema[key].dataType.simpleString()

        def work(batch: pa.Table) -> pa.Table:
            batch = batch.sort_by("pos")
            x, out = matrix(batch.column("packed")), []
            for v in asked:
                sims = networks.transfer_similarity(design, shared.value, x, v.name)
                truth = x[:, v.start]
                out.append(pa.table({"batch_id": batch.column("batch_id"), key: batch.column(key),
                                     "variable": pa.array([v.name] * len(x)), "kind": pa.array([v.kind] * len(x)),
                                     "truth": pa.array(truth), "estimate": pa.array(truth[first_best(sims, axis=0)])}))
            return pa.concat_tables(out)

        batched = assign_batches(packed.select(key, "packed"), key, batch_size)
        schema = f"batch_id bigint, {key} {kind}, variable string, kind string, truth double, estimate double"
        return batched.groupBy("batch_id").applyInArrow(work, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        save_weights(spark, self.trained, path)


def save_weights(spark: SparkSession, trained: Trained, path: str) -> None:
    """Weights as a table (name, shape, data)."""
    nodes = trained.design.unpack(trained.weights)
    rows = [(name, list(node.value.shape), node.value.reshape(-1).tolist()) for name, node in nodes.items()]
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, design: Design, path: str) -> np.ndarray:
    stored = {r["name"]: r for r in spark.read.schema(MODEL_SCHEMA).parquet(path).collect()}
    for name, shape in design.shapes.items():
        if name not in stored or tuple(stored[name]["shape"]) != tuple(shape):
            raise ValueError(f"stored weights do not fit the design at {name}")
    return np.concatenate([np.asarray(stored[name]["data"], dtype=np.float64) for name in design.shapes])


@dataclass
class TablePredictor:
    """Predictor of the card's response on top of an embedder's encoders, or on fresh ones (CONTROL)."""

    latent: int = 32
    settings: Settings = Settings(patience=10)

    def fit_packed(self, packed: DataFrame, packer: RowPacker, embedder: EmbedderModel | None = None) -> "PredictorModel":
        """All weights are trained; those shared with the embedder start from it."""
        if embedder is None:
            design = Design("CONTROL", packer.variables, self.latent, outputs=packer.outputs)
            start = design.initial(self.settings.seed)
        else:
            design = replace(embedder.design, outputs=packer.outputs)
            nodes = design.unpack(design.initial(self.settings.seed))
            known = embedder.design.unpack(embedder.trained.weights)
            start = np.concatenate(
                [(known[n] if n in known and not n.startswith("head.") else node).value.reshape(-1) for n, node in nodes.items()]
            )
        return PredictorModel(packer, train(packed, packer.card.key, design, self.settings, start))


@dataclass
class PredictorModel:
    packer: RowPacker
    trained: Trained

    def transform_packed(self, packed: DataFrame) -> DataFrame:
        """Add ``prediction``: the class code, or the value on the scaled response."""
        design, shared = self.trained.design, packed.sparkSession.sparkContext.broadcast(self.trained.weights)

        @F.arrow_udf("double")
        def predict(rows: pa.Array) -> pa.Array:
            if not len(rows):
                return pa.array([], pa.float64())
            out = networks.predict(design, design.unpack(shared.value), matrix(rows)).value
            return pa.array(out.argmax(axis=1).astype(np.float64) if design.outputs > 1 else out[:, 0])

        return packed.withColumn("prediction", predict("packed")).drop("packed")

    def score(self, packed: DataFrame) -> DataFrame:
        """(split, score): balanced accuracy or mean squared error."""
        rule = balanced_accuracy if self.packer.card.task == "classification" else mse
        return rule(self.transform_packed(packed), "target", "prediction", ["split"])
