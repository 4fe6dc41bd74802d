"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.hashing import hash32
from rowloom.llm.common import Scratch, digest, each_text, key_hash
from rowloom.llm.wordblocks import STEP, mix, word_hashes

BUCKETS = 1 << 16
#: Byte n-grams; a word that follows itself is a bigram of its own kind, in a bucket beside the hashed ones.
GRAMS = (3, 5)
REPEAT_WEIGHT = 5
#: The models are fitted on at most so many labelled rows, taken by key hash.
LABELLED = 50_000
#: One labelled row in so many is kept aside to set the sample's size.
FOLDS = 4
#: Pseudo-counts of the raw model in the target model, and of every bucket in the raw model.
PRIOR, SMOOTHING = 10_000, 0.5
#: Scores are of so many n-grams, so that length alone says nothing; shorter texts than FEW are not scaled up fully.
LENGTH, FEW = 100, 20
#: Bytes of a text counted at once.
PIECE = 1 << 20
#: Points of score by which a document is e times as likely to be drawn as another.
TEMPERATURE = 6.0
#: Steps of a score that the top-k tells apart.
UNIT = 1 << 16


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of a text's hashed n-grams (BUCKETS + 1)."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    counts = np.zeros(BUCKETS + 1, np.int64)
    for n in GRAMS:
        seed = np.array([n], np.uint64) * STEP
        for start in range(0, len(data) - n + 1, PIECE):
            part = data[start:start + PIECE + n - 1].astype(np.uint64)
            gram = np.zeros(len(part) - n + 1, np.uint64)
            for i in range(n):
                gram = gram * np.uint64(257) + part[i:i + len(gram)]
            counts[:BUCKETS] += np.bincount((mix(gram + seed) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    last = None
    for start in range(0, len(data), PIECE):  # a word cut at a piece's end is only lost as a repeat
        words, _, _ = word_hashes(data[start:start + PIECE], False)
        if len(words):
            counts[BUCKETS] += REPEAT_WEIGHT * (int((words[1:] == words[:-1]).sum()) + (last == words[0]))
            last = words[-1]
    return counts


def fit(docs: DataFrame, text: str, quality: str) -> np.ndarray:
    """Log ratio of the target model (rows with quality 1) to the raw model (all rows), per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for value, good in zip(each_text(batch.column(0)), batch.column(1).to_pylist()):
                found = gram_counts(value)
                raw += found
                if good == 1:
                    target += found
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    parts = docs.select(text, F.col(quality).cast("int")).mapInArrow(count, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for bucket, r, t in parts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # at most BUCKETS + 1 rows
        raw[bucket], target[bucket] = r, t
    if not target.any():
        return np.zeros(BUCKETS + 1)
    base = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    return np.log((target + PRIOR * base) / (target.sum() + PRIOR) / base)


def scored(docs: DataFrame, text: str, ratio: np.ndarray) -> DataFrame:
    """Adds ``score``, the log importance weight per LENGTH n-grams of the text; 0 for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            values = []
            for value in each_text(batch.column(len(kept))):
                found = gram_counts(value)
                values.append(LENGTH * float(found @ weights) / max(int(found.sum()), FEW))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(values, pa.float64())], [*[f.name for f in kept], "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", score double"
    return docs.select(*[f.name for f in kept], text).mapInArrow(run, schema)


def cut_between(scores: DataFrame, quality: str) -> float | None:
    """The score that best parts the labelled classes: lowest sum of both error rates, in the middle of the best gap.

    Scores are counted in bins of a signed logarithm, a few thousand at most.
    """
    log = F.signum("score") * F.log1p(F.abs("score"))
    rows = scores.filter(F.col(quality).isNotNull()).groupBy(F.floor(log * 64).alias("bin"), F.col(quality).cast("int").alias("y"))
    bins: dict[int, list[int]] = {}
    for b, y, n in rows.agg(F.count("*")).collect():
        bins.setdefault(b, [0, 0])[1 if y == 1 else 0] += n
    good, bad = (sum(v[i] for v in bins.values()) for i in (1, 0))
    if not good or not bad:
        return None
    best, cut, lost, left = None, None, 0, bad
    order = sorted(bins)
    for i, b in enumerate([*order, order[-1] + 1]):
        error = lost / good + left / bad
        if best is None or error < best:
            low = order[i - 1] + 1 if i else b
            best, cut = error, (low + b) / 2 / 64
        if b in bins:
            lost, left = lost + bins[b][1], left - bins[b][0]
    return float(np.sign(cut) * np.expm1(abs(cut)))


def gumbel(key: str, seed: int = 0) -> Column:
    """Gumbel noise that depends on the key and a seed alone, so that reruns agree."""
    number = hash32(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)) if seed else key_hash(key)
    uniform = (number.cast("double") + 0.5) / float(1 << 32)
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counts in 1024 ranges that narrow down; null if there are fewer."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    while low < high:
        width = (high - low) // 1024 + 1
        bins = F.floor((F.col(column) - low) / F.lit(width)).cast("long")
        counts = dict(rows.filter(F.col(column).between(low, high)).groupBy(bins.alias("b")).agg(F.count("*")).collect())
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= counts[b]
        else:
            return low
    return low


def verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
             labelled: int = LABELLED, k: int | None = None, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """One row per document: the key, score, noisy (score over the temperature plus Gumbel noise), kept and _digest (of
    the text).

    The target model is fitted on rows labelled 1, the raw model on every row. The k documents with the highest noisy
    scores stay, ties included: a draw of k documents one after another, each with a chance in proportion to its
    importance exp(score / temperature) among those that are left. Without ``k`` it is the number of documents whose score is above the one
    that best parts the labelled rows kept aside from the fit. Null and empty texts score 0 and repeated rows score alike. Without
    labels of both classes every document stays.
    """
    scratch = Scratch(docs.sparkSession)
    sample = labels.filter(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_label_key"))
    sample = sample.agg(F.min(quality).alias("_quality")).orderBy(F.xxhash64("_label_key"), "_label_key").limit(labelled)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(sample), rows["_key"] == sample["_label_key"], "left").select("_key", "_quality", "_text")
    aside = key_hash("_key") % FOLDS == 0
    rows = rows.withColumn("_fit", F.when(~aside, F.col("_quality"))).withColumn("_aside", F.when(aside, F.col("_quality")))
    ratio = fit(rows, "_text", "_fit")
    scores = scored(rows.select("_key", "_fit", "_aside", digest("_text").alias("_digest"), "_text"), "_text", ratio)
    scores = scratch.keep(scores.withColumn("noisy", F.col("score") / temperature + gumbel("_key", seed)).withColumn("_rank", F.floor(F.col("noisy") * UNIT).cast("long")), "scores")
    if k is None:
        cut = cut_between(scores, "_aside")
        cut = cut_between(scores, "_fit") if cut is None else cut
        k = None if cut is None else scores.filter(F.col("score") >= cut).count()
    kept = F.lit(True)
    if k is not None and k < scores.count():
        bound = kth_largest(scores, "_rank", k)
        kept = F.lit(False) if bound is None else F.col("_rank") >= bound
    return scores.select(F.col("_key").alias(key), "score", "noisy", kept.alias("kept"), "_digest")


def resampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
              labelled: int = LABELLED) -> DataFrame:
    """The verdicts without the digests."""
    return verdicts(docs, labels, key, text, quality, labelled).drop("_digest")


def filtered(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """The rows that stay, with all their columns. A verdict is for a key with a text, which share noise and score, so rows
    of one key or without one are judged each by its text."""
    gone = verdicts(docs, labels, key, text, quality).filter("NOT kept").select(F.col(key).alias("_dropped"), "_digest").distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["_dropped"]) & (digest(docs[text]) == gone["_digest"]), "left_anti")
