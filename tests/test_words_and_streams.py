import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.cards import DataCard
from rowloom.functions.hashing import split_name
from rowloom.models.embedder import RowPacker, TableEmbedder
from rowloom.models.trainer import Settings
from rowloom.operators.words import TextComponents, dense_components, vocabulary
from rowloom.plans.recipe import Recipe, clean, codes, log1p, minmax
from rowloom.streaming.apply import write_transformed

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(0)
    weights = np.array([rng.dirichlet(np.ones(10) * 0.3) for _ in range(4)])
    rows = [(i, " ".join(rng.choice(WORDS, 30, p=weights[i % 4])), "train" if i < 120 else "test") for i in range(160)]
    rows[5] = (5, "", "train")
    rows[130] = (130, "unknown words only", "test")
    return spark.createDataFrame(rows, "id long, t string, split string").persist()


def numpy_components(texts, width):
    rows = sorted(texts.collect(), key=lambda r: r["id"])
    x = np.array([[r["t"].split().count(w) for w in WORDS] for r in rows], float)
    train = np.array([r["split"] == "train" for r in rows])
    mean = x[train].mean(axis=0)
    _, _, v = np.linalg.svd(x[train] - mean, full_matrices=False)
    return (x - mean) @ v[:width].T


@pytest.mark.parametrize("options", [{}, {"max_basis_bytes": 0}])
def test_text_components_equal_the_svd(texts, options):
    fitted = TextComponents.fit(texts, "id", "t", width=3, **options)
    got = np.array([r["z"] for r in fitted.transform(texts, "id", "t", "z").orderBy("id").collect()])
    expected = numpy_components(texts, 3)
    assert np.allclose(np.abs(got), np.abs(expected), atol=1e-4)


def test_many_words_with_close_components(spark):
    """Several hundred words and singular values that lie close together, on both sides of the broadcast bound."""
    rng = np.random.default_rng(11)
    topics = [rng.permutation(400)[:60] for _ in range(6)]
    rows = [(i, " ".join(f"word{w}" for w in [*rng.choice(topics[i % 6], 40), *rng.integers(0, 400, 20)]), "train") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, t string, split string")
    vocabulary = sorted({w for _, t, _ in rows for w in t.split()})
    counts = np.array([[t.split().count(w) for w in vocabulary] for _, t, _ in rows], float)
    centred = counts - counts.mean(axis=0)
    _, sizes, axes = np.linalg.svd(centred, full_matrices=False)
    assert len(vocabulary) >= 300 and sizes[0] / sizes[3] < 1.2 and sizes[4] / sizes[5] > 1.2
    for options in ({}, {"max_basis_bytes": 0}):
        fitted = TextComponents.fit(df, "id", "t", width=4, **options)
        out = fitted.transform(df, "id", "t", "c").orderBy("id").collect()
        found = np.array([r["c"] for r in out])
        wanted = centred @ axes[:4].T
        wanted *= np.sign((wanted * found).sum(axis=0))
        assert np.abs(found - wanted).max() < 0.02 * np.abs(wanted).max()


def test_vocabulary_counts(texts):
    counts = {r["token"]: r["n"] for r in vocabulary(texts.filter("split = 'train'"), "t").collect()}
    assert set(counts) == set(WORDS) and sum(counts.values()) == 119 * 30


def test_dense_components_equal_the_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((100, 6)) * np.arange(1, 7)
    df = spark.createDataFrame([(i, v.tolist(), "train" if i < 80 else "test") for i, v in enumerate(x)], "id long, v array<double>, split string")
    got = np.array([r["z"] for r in dense_components(df, "v", "z", 2).orderBy("id").collect()])
    mean = x[:80].mean(axis=0)
    _, _, v = np.linalg.svd(x[:80] - mean, full_matrices=False)
    assert np.allclose(np.abs(got[:80]), np.abs(((x - mean) @ v[:2].T)[:80]), atol=1e-8)
    assert np.abs(got[:80].mean(axis=0)).max() < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"Text no. {i}!", "xyz"[i % 3], float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, t string, k string, v double").withColumn("split", split_name("id"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    fitted = Recipe((clean("t"), codes("k"), log1p("v"), minmax("v"))).fit(df)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_transformed(stream, fitted.transform, str(tmp_path / "out"), str(tmp_path / "log"), once=True)
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(fitted.transform(df)).count() == 0 and got.count() == 90


def test_stream_of_embeddings(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i % 7), "train" if i < 70 else "validation") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, k string, v double, split string")
    df.write.parquet(str(tmp_path / "in"))
    model = TableEmbedder("CLIP", 2, settings=Settings(epochs=1, batch_size=16)).fit(df, DataCard("id", cat=["k"], num=["v"]))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = write_transformed(stream, model.transform, str(tmp_path / "out"), str(tmp_path / "log"), once=True)
    assert query.awaitTermination(120)
    got = {r["id"]: r["embedding"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {r["id"]: r["embedding"] for r in model.transform(df).collect()}
    assert got.keys() == expected.keys() and np.allclose([got[i] for i in range(90)], [expected[i] for i in range(90)])
