"""Rows without a key and rows that repeat a key are documents of their own where their texts differ."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import mixing, near, quality, substring
from rowloom.llm.common import ROW_ID, Scratch, identified
from tests.llm import corpora

SCHEMA = "doc_id long, text string, source string"


def rows():
    """(key, text, source) with passages that rows without a key, with a repeated key and with a key of their own share."""
    rng = random.Random(12)
    passage, other = corpora.sentence(rng, 40), corpora.sentence(rng, 40)
    unique = [corpora.sentence(rng, 40) for _ in range(9)]
    out = [(1, passage, "a"), (None, passage, "a"), (None, unique[0], "b"), (2, passage, "a"), (2, unique[1], "b"), (2, unique[1], "b")]
    out += [(3, f"{unique[2]} {other}", None), (3, f"{unique[3]} {other}", None), (None, f"{other} {unique[4]}", None), (-4, unique[5], "a")]
    return out + [(None, None, "a"), (5, None, "b"), (5, unique[6], "b"), (None, unique[7], "c"), (7, unique[8], "c")]


def test_ids_follow_keys_and_texts(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    ids = identified(docs, "doc_id", "text", Scratch(spark))
    found = [(r["doc_id"], r["text"] or "", r[ROW_ID], r["back"]) for r in ids.rows.withColumn("back", ids.key(ROW_ID, "long")).collect()]
    assert Counter((k, t) for k, t, _, _ in found) == Counter((k, t or "") for k, t, _ in rows())
    assert len({i for _, _, i, _ in found}) == len({(k, t) for k, t, _, _ in found})
    assert all(k == back for k, _, _, back in found)
    order = [k for k, _, _, _ in sorted(found, key=lambda r: r[2])]
    assert order == sorted(order, key=lambda k: (k is None, k or 0))
    plain = identified(docs.filter("doc_id IN (1, 7)"), "doc_id", "text", Scratch(spark)).rows
    assert all(r[ROW_ID] == r["doc_id"] for r in plain.collect())
    with pytest.raises(ValueError, match="too large"):
        identified(docs.withColumn("doc_id", F.col("doc_id") + F.lit(1 << 62)), "doc_id", "text", Scratch(spark))


@pytest.mark.parametrize("digests", [False, True])
def test_repeats_are_judged_by_row(spark, digests):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    ids = identified(docs, "doc_id", "text", Scratch(spark)).rows.select(ROW_ID, "doc_id", "text").distinct().collect()
    wanted = corpora.without_repeats({r[ROW_ID]: r["text"] for r in ids})
    by_row = {r[ROW_ID]: (r["doc_id"], r["text"] or "") for r in ids}
    expected = Counter()
    for k, t, _ in rows():
        n, gone, _ = next(wanted[i] for i, row in by_row.items() if row == (k, t or ""))
        expected[k, n, gone] += 1
    found = substring.without_repeats(docs, digests=digests).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in found) == expected
    assert expected[None, 40, 0] == 2  # the two unique texts without a key are whole


def test_near_copies_are_removed_by_row(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = Counter((r["doc_id"], r["text"]) for r in near.deduplicated(docs).collect())
    wanted = Counter((k, t) for k, t, _ in rows())
    passage = rows()[0][1]
    del wanted[None, passage], wanted[2, passage]
    assert found == wanted and near.deduplicated(docs).columns == docs.columns


def test_mix_serves_repeated_rows_exactly(spark):
    many = [(1, f"word {i} " * 3, "a") for i in range(4)] + [(2, "same words here", "a")] * 2 + [(None, "no key " * 4, "a")] * 3
    many += [(10 + i, "other source " * 5, "b") for i in range(6)]
    docs = spark.createDataFrame(many, SCHEMA).repartition(3)
    size = mixing.word_count("text")
    served = mixing.queue(identified(docs, "doc_id", "text", Scratch(spark)).rows, ROW_ID, "source", size).filter("take = size AND take > 0")
    out = mixing.mixed(docs, "doc_id", "source", size).collect()
    assert len(out) == served.count()
    assert sum(len(r["text"].split()) for r in out) == served.agg(F.sum("take")).first()[0]


def test_draws_are_plackett_luce(spark):
    """Inclusion rates over many seeds against a brute-force draw without replacement by importance."""
    rng = random.Random(2)
    texts = [corpora.sentence(rng, 30) if i % 3 else "%% || " * 15 for i in range(24)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 24, 2)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.resampled(docs, labels).collect()}
    heat, k, seeds = max(abs(s) for s in scores.values()) / 2, 9, 400
    frame = spark.createDataFrame([(i, s) for i, s in scores.items()], "_key long, score double")
    noise = frame.select("_key", *[(F.col("score") / heat + quality.gumbel("_key", s + 1)).alias(f"z{s}") for s in range(seeds)]).toPandas()
    drawn = np.zeros(24)
    for s in range(seeds):
        drawn[noise["_key"].to_numpy()[np.argsort(-noise[f"z{s}"].to_numpy())[:k]]] += 1
    numbers, brute = np.random.default_rng(0), np.zeros(24)
    weight = np.exp(np.array([scores[i] for i in range(24)]) / heat)
    for _ in range(4000):
        brute[numbers.choice(24, k, replace=False, p=weight / weight.sum())] += 1
    assert np.abs(drawn / seeds - brute / 4000).max() < 0.1

    def kept(seed):
        return {r["doc_id"] for r in quality.verdicts(docs, labels, k=k, temperature=heat, seed=seed).filter("kept").collect()}

    first, second = kept(1), kept(2)
    assert len(first) == len(second) == k and first != second and kept(1) == first
