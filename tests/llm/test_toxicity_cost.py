"""The kernel's recursion against its definition, and how often words are met."""

import random
from itertools import combinations

import numpy as np
import pytest

from rowloom.llm import toxicity
from tests.llm import corpora


def by_definition(a, b, order, decay):
    return sum(
        decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        for i in combinations(range(len(a)), order) for j in combinations(range(len(b)), order)
        if all(a[x] == b[y] for x, y in zip(i, j))
    )


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kernel_of_every_order_is_its_definition(order):
    rng = random.Random(order)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 8)))) for _ in range(60)]
    left, right = toxicity.codes([a for a, _ in pairs], 6), toxicity.codes([b for _, b in pairs], 8)
    expected = [by_definition(a, b, order, 0.75) for a, b in pairs]
    assert toxicity.subsequence_kernel(left, right, order).tolist() == pytest.approx(expected)
    one = [by_definition("abcab", b, order, 0.75) for _, b in pairs]
    assert toxicity.subsequence_kernel(toxicity.codes(["abcab"], 5), right, order).tolist() == pytest.approx(one)


def test_strengths_do_not_depend_on_the_words_met_together():
    rng = random.Random(4)
    marks = ["idiot", "stupid", "scum", "abcdefghij"]
    words = ["", "i", *marks] + ["".join(rng.choices("abcdiopstum", k=rng.choice([3, 6, 9, 40, 90]))) for _ in range(400)]
    alone = np.concatenate([toxicity.strength([w], marks) for w in words])
    assert (toxicity.strength(words, marks) == alone).all() and alone.any(axis=1).sum() > len(marks)


def test_a_query_lists_the_words_of_the_corpus_only_on_demand(spark, monkeypatch):
    """Beyond the size that is sent to workers, words were met twice: once for the corpus and again by each worker."""
    rng = random.Random(5)
    texts = [corpora.sentence(rng, 30) + (" you snaburk" if i % 4 == 0 else "") for i in range(160)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    listed, calls = toxicity.corpus_words, []
    monkeypatch.setattr(toxicity, "corpus_words", lambda *a: calls.append(1) or listed(*a))
    found = sorted(toxicity.toxicity(df, marks).collect())
    assert not calls
    assert sorted(toxicity.toxicity(df, marks, sent_bytes=1 << 20).collect()) == found and calls
