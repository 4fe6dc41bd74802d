"""Components of texts whose vocabulary is far larger than what the driver may hold."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from rowloom.functions.hashing import chained_xxhash64, xxhash64_of
from rowloom.operators.words import TextComponents


def test_hashes_equal_spark(spark):
    texts = ["", "a", "abc", "abcd", "abcdefg", "abcdefgh", "abcdefghijkl", "zé" * 9, "x" * 31, "y" * 32, "zé" * 20, "q" * 37, "w" * 64]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h"), F.xxhash64("t", F.lit(17)).alias("g")).collect()
    hashes = xxhash64_of([r["t"].encode() for r in rows])
    assert hashes.tolist() == [r["h"] for r in rows]
    assert chained_xxhash64(hashes, 17).tolist() == [r["g"] for r in rows]


def test_driver_holds_no_basis(spark):
    """60,000 terms in 300 texts: no block of 60,000 x 18 numbers comes to the driver."""
    own = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("x"), i))
    topic = F.array_repeat(F.concat(F.lit("topic"), F.col("id") % 4), (F.col("id") % 7 + 3).cast("int"))
    df = spark.range(300).select("id", F.array_join(F.concat(own, topic), " ").alias("t"), F.lit("train").alias("split"))
    tracemalloc.start()
    fitted = TextComponents.fit(df, "id", "t", width=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fitted.n_terms == 60_004
    assert peak < 60_000 * 18 * 8
    assert fitted.transform(df, "id", "t", "c").filter(F.size("c") == 3).count() == 300


def test_rows_of_one_key_are_one_document(spark):
    """Repeated and missing keys, empty and null texts, over several shards of terms."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{w}" for w in rng.integers(0, 300, 40)) for _ in range(60)]
    rows = [(i % 50 if i != 7 else None, t, "train") for i, t in enumerate(texts)] + [(90, "", "train"), (91, None, "train"), (92, "nothing known", "test")]
    df = spark.createDataFrame(rows, "id long, t string, split string")
    merged: dict = {}
    for key, text, split in rows:
        if split == "train":
            merged.setdefault(key, []).extend((text or "").split())
    words = sorted({w for found in merged.values() for w in found})
    counts = {key: np.array([found.count(w) for w in words], float) for key, found in merged.items()}
    n_train = sum(split == "train" for _, _, split in rows)
    mean = np.sum(list(counts.values()), axis=0) / n_train
    met = np.array([c for c in counts.values() if c.any()])
    product = met.T @ (met - mean)  # documents without words pull no term
    values, axes = np.linalg.eig(product)
    order = np.argsort(-values.real)[:2]
    fitted = TextComponents.fit(df, "id", "t", width=2, tolerance=1e-9, max_basis_bytes=0)
    assert fitted.shards > 1 and fitted.n_terms == len(words)
    out = [(r["id"], np.array(r["c"])) for r in fitted.transform(df, "id", "t", "c").collect()]
    assert len(out) == len(rows)
    for key, found in out:
        if key is not None and key != 92:
            wanted = (counts[key] - mean) @ axes[:, order].real
            assert np.allclose(np.abs(found), np.abs(wanted), atol=0.05 * np.abs(met @ axes[:, order].real).max())
    outside = [found for key, found in out if key is None or key == 92]
    assert all(np.allclose(found, outside[0]) for found in outside)
