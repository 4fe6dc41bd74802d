import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.cards import DataCard
from rowloom.models import networks
from rowloom.models.embedder import RowPacker, TableEmbedder, TablePredictor, load_weights, save_weights
from rowloom.models.networks import METHODS, TRANSFER_METHODS, Design, Variable
from rowloom.models.trainer import Settings, run_batches, train
from rowloom.operators.metrics import imputation_scores
from rowloom.operators.retrieval import first_best
from rowloom.sources.blobs import xor_blobs

MIXED = (Variable("e", "dense", 0, 3), Variable("c", "cat", 3, 1, 4), *[Variable(n, "num", 4 + i, 1) for i, n in enumerate("xyz")])
BLOBS = DataCard("row_id", cat=["c"], num=["x", "y"], levels=2)


def batch(n=6, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.standard_normal((n, 3)), rng.integers(0, 4, (n, 1)), rng.standard_normal((n, 3))], axis=1)


def numeric(f, w, step=1e-6):
    eye = np.eye(len(w)) * step
    return np.array([(f(w + e) - f(w - e)) / (2 * step) for e in eye])


@pytest.mark.parametrize("method", METHODS)
def test_contrastive_gradients(method):
    design = Design(method, MIXED, 3, hidden=4, phi=(5, 4), anchors=3)
    w, x = design.initial(1), batch()

    def loss(w):
        p = design.unpack(w)
        return p, networks.contrastive_loss(design, p, x, np.random.default_rng(7))

    p, value = loss(w)
    value.backward()
    expected = numeric(lambda w: float(loss(w)[1].value), w)
    assert np.abs(design.gradient(p) - expected).max() < 1e-5 * max(1.0, np.abs(expected).max())


@pytest.mark.parametrize("method,outputs", [("ANCHOR", 3), ("GMC", 1), ("CONTROL", 3)])
def test_predictor_gradients(method, outputs):
    design = Design(method, MIXED, 3, hidden=4, phi=(5,), outputs=outputs)
    w, x, y = design.initial(2), batch(), np.array([0.0, 1, 2, 2, 1, 0])

    def loss(w):
        p = design.unpack(w)
        return p, networks.prediction_loss(design, p, x, y)

    p, value = loss(w)
    value.backward()
    assert np.abs(design.gradient(p) - numeric(lambda w: float(loss(w)[1].value), w)).max() < 1e-5


def unit(a):
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def cross_entropy(s):
    return np.mean([np.log(np.exp(s[i]).sum()) - s[i, i] for i in range(len(s))])


def test_losses_against_plain_numpy():
    x = batch(5)
    design = Design("CLIP", MIXED, 3)
    p = design.unpack(design.initial(3))
    h = [n.value for n in networks.encode(design, p, x).values()]
    expected = np.mean([cross_entropy(sum(unit(a) @ unit(b).T for j, b in enumerate(h) if j != i) / 0.07) for i, a in enumerate(h)])
    assert float(networks.contrastive_loss(design, p, x, None).value) == pytest.approx(expected)

    design = Design("ANCHOR", MIXED, 3, hidden=4, phi=(5,))
    p = design.unpack(design.initial(3))
    h = [n.value for n in networks.encode(design, p, x).values()]
    f = lambda a: np.maximum(a @ p["phi.w0"].value + p["phi.b0"].value, 0) @ p["phi.w1"].value + p["phi.b1"].value
    expected = sum(cross_entropy(unit(f(a)) @ unit(f(sum(b for j, b in enumerate(h) if j != i) / 4)).T / 0.07) for i, a in enumerate(h))
    assert float(networks.contrastive_loss(design, p, x, None).value) == pytest.approx(expected)
    assert np.allclose(networks.embed(design, design.initial(3), x), f(sum(h) / 5))


def test_designs_reject_what_they_cannot_train():
    with pytest.raises(ValueError):
        Design("CLIP", MIXED[:1], 3)
    with pytest.raises(ValueError):
        Design("OTHER", MIXED, 3)


def test_subtab_blocks():
    def blocks(m):
        return Design("SUBTAB", tuple(Variable(str(i), "num", i, 1) for i in range(m)), 2).blocks()

    assert blocks(3) == [(0, 1), (1, 2), (2, 3)]
    assert blocks(8) == [(0, 3), (1, 4), (3, 6), (5, 8)]


def test_parameter_counts_of_published_shapes():
    pair = (Variable("c", "cat", 0, 1, 2), Variable("x", "num", 1, 1), Variable("y", "num", 2, 1))
    assert Design("CLIP", pair, 2).parameter_count() == 25
    six = (Variable("a", "cat", 0, 1, 12), Variable("b", "cat", 1, 1, 31), *[Variable(str(i), "num", i, 1) for i in range(2, 5)])
    assert Design("MCN", six, 32, anchors=409).parameter_count() == 43 * 32 + 3 * (64 + 32 * 33) + 409 * 32


@pytest.fixture(scope="module")
def blobs(spark):
    df = xor_blobs(spark, seed=3).persist()
    packer = RowPacker.fit(df, BLOBS)
    return df, packer, packer.transform(df).persist()


def test_blobs_table(blobs):
    df = blobs[0]
    rows = df.groupBy("split").agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.avg("c")).collect()
    assert {r["split"]: r["n"] for r in rows} == {"train": 1000, "validation": 100, "test": 100}
    assert all(tuple(r)[2:] == (0.0, 1.0, 0.0, 1.0, 0.5) for r in rows)


def test_one_partition_equals_a_plain_loop(spark, blobs):
    _, packer, packed = blobs
    settings = Settings(epochs=2, batch_size=64, learning_rate=0.01, partitions=1)
    design = Design("ANCHOR", packer.variables, 2, 4, (4,))
    result = train(packed, "row_id", design, settings)
    w = design.initial(0)
    state, steps = np.concatenate([w, np.zeros(2 * len(w))]), 0
    rows = packed.filter("split = 'train'").select("row_id", "packed")
    for epoch in range(2):
        ordered = rows.orderBy(F.xxhash64("row_id", F.lit(0), F.lit(epoch)), "row_id").collect()
        x = np.array([r["packed"] for r in ordered])
        batches = [(x[i : i + 64], None) for i in range(0, 1000, 64)]
        state, steps, *_ = run_batches(design, state, steps, batches, settings, np.random.default_rng(0))
    assert np.allclose(result.weights, state[: len(w)], atol=1e-12)


def test_more_partitions_still_learn(blobs):
    _, packer, packed = blobs
    settings = Settings(epochs=4, batch_size=32, learning_rate=0.02, partitions=3)
    track = train(packed, "row_id", Design("ANCHOR", packer.variables, 4, 8, (8,)), settings).track
    assert track[-1][1] < track[0][1]


def test_only_the_anchor_method_solves_the_blobs(blobs):
    """The class needs both axes together, so sums of pairwise similarities cannot tell it."""
    _, packer, packed = blobs
    x = np.array([r["packed"] for r in packed.filter("split = 'train'").orderBy("row_id").collect()])
    held = packed.filter("split = 'test'")
    accuracy = {}
    for method in TRANSFER_METHODS:
        design = Design(method, packer.variables, 4, 4, (4, 4), anchors=3)
        w = design.initial(0)
        state, steps, settings = np.concatenate([w, np.zeros(2 * len(w))]), 0, Settings(batch_size=32, learning_rate=0.01)
        for epoch in range(20):
            order = np.random.default_rng(epoch).permutation(1000)
            batches = [(x[order[i : i + 32]], None) for i in range(0, 1000, 32)]
            state, steps, *_ = run_batches(design, state, steps, batches, settings, np.random.default_rng(epoch))
        test = np.array([r["packed"] for r in held.collect()])
        sims = networks.transfer_similarity(design, state[: len(w)], test, "c")
        accuracy[method] = (test[first_best(sims, axis=0), 0] == test[:, 0]).mean()
    assert accuracy["ANCHOR"] > 0.85 and max(v for m, v in accuracy.items() if m != "ANCHOR") < 0.8


def test_embed_impute_save(spark, blobs, tmp_path):
    _, packer, packed = blobs
    settings = Settings(epochs=8, batch_size=32, learning_rate=0.02, partitions=1)
    model = TableEmbedder("ANCHOR", 4, 8, (8,), settings).fit_packed(packed, packer)
    rows = model.transform_packed(packed).select("row_id", "embedding").orderBy("row_id").limit(5).collect()
    x = np.array([r["packed"] for r in packed.orderBy("row_id").limit(5).collect()])
    assert np.allclose([r["embedding"] for r in rows], networks.embed(model.design, model.trained.weights, x))
    scores = {r["variable"]: r["score"] for r in imputation_scores(model.impute_packed(packed.filter("split = 'test'"), 32)).collect()}
    assert set(scores) == {"c", "x", "y"} and 0 <= scores["c"] <= 1
    save_weights(spark, model.trained, str(tmp_path / "weights"))
    assert np.allclose(load_weights(spark, model.design, str(tmp_path / "weights")), model.trained.weights)
    with pytest.raises(ValueError):
        load_weights(spark, Design("ANCHOR", packer.variables, 5, 8, (8,)), str(tmp_path / "weights"))


def test_predictor_learns_a_linear_response(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"k{i % 3}", float(a), float(a * 2 + i % 3), "train" if i < 500 else "test" if i < 600 else "validation") for i, a in enumerate(rng.random(700))]
    df = spark.createDataFrame(rows, "id long, k string, a double, y double, split string")
    card = DataCard("id", cat=["k"], num=["a", "y"], response="y")
    packer = RowPacker.fit(df, card)
    packed = packer.transform(df).persist()
    head = TablePredictor(8, Settings(epochs=12, batch_size=32, learning_rate=0.02, patience=10, partitions=1)).fit_packed(packed, packer)
    scores = {r["split"]: r["score"] for r in head.score(packed).collect()}
    spread = packed.agg(F.var_pop("target")).first()[0]
    assert scores["test"] < 0.2 * spread


def test_unseen_levels_and_missing_numbers_still_embed(spark):
    rows = [(i, "ab"[i % 2], float(i), "train" if i < 50 else "validation") for i in range(60)] + [(60, "new", None, "test")]
    df = spark.createDataFrame(rows, "id long, k string, v double, split string")
    card = DataCard("id", cat=["k"], num=["v"])
    model = TableEmbedder("CLIP", 2, settings=Settings(epochs=1, batch_size=16)).fit(df, card)
    assert len(model.transform(df).filter("split = 'test'").first()["embedding"]) == 2
