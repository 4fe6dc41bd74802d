"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

Regular expressions, gazetteers and context words vote yes, no or nothing on every candidate of every text. Spark counts
the vote patterns (at most 3^7 a kind), expectation-maximisation over those counts estimates how reliable each labeler
is, and a logistic model of the spans' features is trained on all candidates with the estimated probabilities as labels.
Base spans stay whatever it says; of the loose candidates those that it accepts are added.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import Scratch
from rowloom.llm.piispans import BUCKETS, FEATURES, KINDS, LABELERS, SpanColumns

SPANS = "array<struct<kind: int, start: int, stop: int, base: boolean, votes: int, features: array<int>>>"
#: Spans are handed on when a task has gathered so many.
FLUSH = 20_000
THRESHOLD = 0.5
#: Votes below this have none of the base pattern. Matches that failed their check train the model but are never added.
LOOSE = 3 ** (len(LABELERS) - 1)
ROUNDS = 60
#: Pseudo-counts of (nothing, no, yes) for spans that are no personal data and for those that are: they keep the two
#: classes from being exchanged and a rare vote from counting as certain.
PRIOR = np.array([[2.0, 3.0, 1.0], [2.0, 1.0, 3.0]])


def candidate_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, spans)``: one row per document, its candidates by kind and start; null texts are empty."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = SpanColumns(), 0
            for i, value in enumerate(batch.column(1)):
                found.add(value.as_py() or "")
                if len(found.kind) >= FLUSH:
                    yield _span_batch(batch.column(0).slice(first, i + 1 - first), found, key)
                    found, first = SpanColumns(), i + 1
            if first < batch.num_rows:
                yield _span_batch(batch.column(0).slice(first), found, key)

    rows = docs.select(F.col(key), F.col(text))
    head = rows.select(F.col(key)).schema.simpleString()[7:-1]
    return rows.mapInArrow(find, f"{head}, spans {SPANS}")


def _span_batch(keys: pa.Array, found: SpanColumns, key: str) -> pa.RecordBatch:
    ints = lambda a: pa.array(np.frombuffer(a, np.int32) if len(a) else np.zeros(0, np.int32))
    n = len(found.kind)
    features = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * FEATURES), ints(found.features))
    base = pa.array(np.frombuffer(found.base, np.int8).astype(bool) if n else np.zeros(0, bool))
    structs = pa.StructArray.from_arrays(
        [ints(found.kind), ints(found.start), ints(found.end), base, ints(found.votes), features],
        names=["kind", "start", "stop", "base", "votes", "features"],
    )
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ints(found.ends), structs)], names=[key, "spans"])


def estimated(counts: np.ndarray, votes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability that each vote pattern is personal data, vote probabilities per labeler and class, share).

    ``votes`` has one row per pattern and one column per labeler. Labelers are independent given the class.
    """
    counts = counts.astype(float)
    each = votes[:, :, None] == np.arange(3)
    belief = 1 / (1 + np.exp(-1.5 * (each[:, :, 2].sum(1) - each[:, :, 1].sum(1))))
    for _ in range(rounds):
        weight = np.stack((counts * (1 - belief), counts * belief))
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        tables = np.einsum("cp,plv->clv", weight, each) + PRIOR[:, None, :]
        tables /= tables.sum(axis=2, keepdims=True)
        odds = np.einsum("plv,lv->p", each, np.log(tables[1]) - np.log(tables[0])) + math.log(share / (1 - share))
        belief = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    return belief, tables, share


def pattern_beliefs(spans: DataFrame) -> list[tuple[int, int, float]]:
    """(kind, votes, probability) of every vote pattern among the exploded ``spans``: counts of all documents."""
    rows = spans.groupBy("kind", "votes").count().collect()
    powers = 3 ** np.arange(len(LABELERS) - 1, -1, -1)
    out = []
    for kind in range(len(KINDS)):
        mine = sorted((r["votes"], r["count"]) for r in rows if r["kind"] == kind)
        if mine:
            codes, counts = (np.array(c) for c in zip(*mine))
            belief, _, _ = estimated(counts, codes[:, None] // powers % 3)
            out += [(kind, int(v), float(b)) for v, b in zip(codes, belief)]
    return out


def fit_weights(spans: DataFrame) -> tuple[np.ndarray, float] | None:
    """(weight of each feature bucket, offset) of the span classifier; None without candidates.

    Each candidate counts as personal data with its estimated probability and as none with the rest. Equal feature
    lists are summed first, so copies of a document cost one row.
    """
    beliefs = pattern_beliefs(spans)
    if not beliefs:
        return None
    session = spans.sparkSession
    table = F.broadcast(session.createDataFrame(beliefs, "kind int, votes int, belief double"))  # at most 4 * 3^7 rows
    sums = spans.join(table, ["kind", "votes"]).groupBy("features").agg(F.sum("belief").alias("yes"), F.sum(1 - F.col("belief")).alias("no"))
    soft = F.explode(F.array(*[F.struct(F.lit(v).alias("label"), F.col(c).alias("weight")) for v, c in ((1.0, "yes"), (0.0, "no"))]))
    rows = sums.select(F.col("features").cast("array<string>").alias("terms"), soft.alias("_s")).select("terms", "_s.*").where("weight > 0")
    hashing = HashingTF(inputCol="terms", outputCol="x", numFeatures=1 << 18, binary=True)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=40, regParam=1e-4, standardization=False).fit(
        hashing.transform(rows).select("x", "label", "weight")
    )
    learned = model.coefficients.toArray()
    return np.array([learned[hashing.indexOf(str(b))] for b in range(BUCKETS)]), float(model.intercept)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``key``, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of the base spans; ``spans`` lists them and the n_added ones that the classifier
    accepts, as kind:start:end in code points. Rows are never joined, so null and repeated keys are rows like any other.
    """
    found = Scratch(docs.sparkSession).keep(candidate_spans(docs, key, text), "spans")
    each = found.select(F.explode("spans").alias("_span")).select("_span.*")
    fitted = fit_weights(each)
    kept = F.col("spans")
    if fitted:
        weights, offset = fitted
        table = F.from_json(F.lit(json.dumps(weights.tolist())), "array<double>")
        least = math.log(threshold / (1 - threshold)) - offset

        def accepted(span: Column) -> Column:
            score = F.aggregate(F.array_distinct(span["features"]), F.lit(0.0), lambda total, f: total + F.get(table, f))
            return (span["votes"] < LOOSE) & (score >= least)

        kept = F.filter("spans", lambda s: s["base"] | accepted(s))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda kind: kind == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col(key), *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(kept).alias("spans"),
        (F.size(kept) - F.size(base)).cast("long").alias("n_added"),
    )
