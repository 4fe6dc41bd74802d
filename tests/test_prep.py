import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowloom.cards import REST, DataCard, card_from_fields, level_check
from rowloom.functions.hashing import hash32, split_name
from rowloom.functions.text import clean_text, tokens
from rowloom.operators import columns as ops
from rowloom.operators.encoding import LevelCodes, OneHot, levels_of, one_hot_sparse, rank_levels
from rowloom.operators.lookup import hot_keys, lookup_join, table_bytes
from rowloom.operators.sampling import _cuts, assign_batches, range_starts, subsample, with_split
from rowloom.operators.scaling import MinMax
from rowloom.plans.recipe import Recipe, cast, clean, codes, log1p, minmax, not_null, rename_map, sanitize
from rowloom.sources.datasets import DATASETS


@pytest.fixture()
def mixed(spark):
    rows = [
        (1, "a", 0.0, None, "train"), (2, "b", -1.0, "x y", "train"), (3, "a", float("nan"), "Don't  stop!", "train"),
        (4, "c", 9.0, "", "test"), (5, None, 99.0, "one", "train"), (6, "a", None, "two words", "test"),
    ]
    return spark.createDataFrame(rows, "id long, k string, v double, t string, split string")


def values(df, column, key="id"):
    return {r[key]: r[column] for r in df.collect()}


def test_card_checks_levels_and_order():
    card = DataCard("id", txt=["t"], cat=["k", "y"], num=["v"], response="y", levels=[3, 2])
    assert card.variables == ["t", "k", "y", "v"] and card.features == ["t", "k", "v"]
    assert card.levels == {"k": 3, "y": 2} and card.task == "classification"
    assert DataCard("id", cat=["k", "y"], levels=2).levels == {"k": 2, "y": 2}
    with pytest.raises(ValueError):
        DataCard("id", cat=["k", "y"], levels=[3])
    assert card_from_fields("id", {"cat_vars": ["k"], "num_vars": ["v"], "response": "v", "cat_levels": 4}).task == "regression"


def test_card_binds_patterns(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.5, 0.1, 2.0)], "id long, cat1 int, cat2 int, cont1 double, other double, loss double")
    card = DataCard("id", cat=["cat*"], num=["loss", REST], response="loss").bind(df)
    assert card.cat == ["cat1", "cat2"] and card.num == ["loss", "cont1", "other"]
    with pytest.raises(ValueError):
        DataCard("id", num=["absent"]).bind(df)


def test_level_check_flags_codes_beyond_the_card(spark):
    df = spark.createDataFrame([(1, 0), (2, 4)], "id long, k long")
    assert level_check(df, DataCard("id", cat=["k"], levels=3)).first()["fits"] is False


def test_sanitize_fails_on_collision(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "a_b"])
    with pytest.raises(ValueError):
        ops.sanitize_names(df)
    with pytest.raises(ValueError):
        ops.rename(df, {"missing": "x"})


def test_logs_are_null_outside_their_domain(mixed):
    logs = values(ops.log10(mixed, "v"), "v")
    assert logs[1] is None and logs[2] is None and logs[4] == pytest.approx(math.log10(9.0))
    ones = values(ops.log1p(mixed, "v"), "v")
    assert ones[2] is None and ones[1] == 0.0


def test_nan_becomes_null(mixed):
    assert values(ops.nan_to_null(mixed), "v")[3] is None


def test_minmax_constant_column_and_train_fit(mixed):
    whole = values(MinMax.fit(mixed, ["v"]).transform(ops.nan_to_null(mixed)), "v")
    assert whole[2] == 0.0 and whole[5] == 1.0 and whole[6] is None
    train = MinMax.fit(mixed.filter("id < 3"), ["v"], train_only=True).transform(mixed)
    assert values(train, "v")[4] == pytest.approx(10.0)  # outside the fitted range, not clipped
    constant = mixed.withColumn("v", F.lit(3.0))
    assert set(values(MinMax.fit(constant, ["v"]).transform(constant), "v").values()) == {0.0}


def test_codes_orders_and_unseen(spark, mixed):
    numbers = spark.createDataFrame([(1, 10), (2, 9), (3, 100)], "id long, n int")
    assert values(LevelCodes.fit(numbers, ["n"], order="lexical").transform(numbers), "n") == {1: 0, 3: 1, 2: 2}
    assert values(LevelCodes.fit(numbers, ["n"], order="numeric").transform(numbers), "n") == {2: 0, 1: 1, 3: 2}
    known = mixed.filter("k is not null")
    kept = LevelCodes.fit(known, ["k"], train_only=True, unseen="keep").transform(known)
    assert values(kept, "k")[4] == 2
    skipped = LevelCodes.fit(known, ["k"], train_only=True, unseen="skip").transform(known)
    assert 4 not in values(skipped, "k")
    with pytest.raises(PySparkException):
        LevelCodes.fit(known, ["k"], train_only=True, unseen="error").transform(known).collect()


def test_ranks_of_large_level_tables_equal_the_window(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 1700).alias("a"), (F.col("id") % 13).alias("b"))
    levels = levels_of(df, ["a", "b"])
    small = {(r.variable, r.level): r.code for r in rank_levels(levels).collect()}
    large = {(r.variable, r.level): r.code for r in rank_levels(levels, max_window_rows=10).collect()}
    assert small == large and len(small) == 1713


@pytest.mark.parametrize("hot_share", [1 / 256, 1 / 8, 1.0])
def test_salted_lookup_equals_broadcast_under_skew(spark, hot_share):
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 50)
    df = spark.range(3000).withColumn("k", key)
    table = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("left", "inner"):
        near = sorted(map(tuple, lookup_join(df, table, ["k"], how).collect()), key=str)
        far = sorted(map(tuple, lookup_join(df, table, ["k"], how, max_broadcast_bytes=0, hot_share=hot_share).collect()), key=str)
        assert near == far and (len(far) == 3000) == (how == "left")


def test_hot_keys_get_salts_by_their_share(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    df = spark.range(30000).withColumn("k", key)
    salts = hot_keys(df, ["k"], 1 / 20)
    name = df.select(F.xxhash64(F.lit("hot")).alias("h")).first()["h"]
    assert salts == {name: 7} and hot_keys(df.filter("id < 0"), ["k"]) == {}
    joined = lookup_join(df, df.select("k").distinct().withColumn("w", F.lit(1)), ["k"], max_broadcast_bytes=0, hot_share=1 / 20)
    sizes = joined.repartition(64, "k").count(), joined.where("w = 1").count()
    assert sizes == (30000, 30000)


def test_table_bytes_follow_the_values(spark):
    rows = [("x" * 100, [1.0] * 50, 1)] * 10
    table = spark.createDataFrame(rows, "a string, v array<double>, n int")
    assert 10 * (100 + 400) < table_bytes(table) < 10 * 1000 and table_bytes(table.limit(0)) == 0


def test_one_hot_policies(mixed):
    known = mixed.filter("k is not null")
    rows = values(OneHot.fit(known, ["k"], []).transform(known), "features")
    assert rows[1] == [1.0, 0.0] and rows[4] == [0.0, 0.0]
    with pytest.raises(PySparkException):
        OneHot.fit(known, ["k"], [], unseen="error").transform(known).collect()
    sparse = values(one_hot_sparse(known.na.fill(0.0, ["v"]).withColumn("v", F.nanvl("v", F.lit(0.0))), ["k"], ["v"]), "features")
    assert sparse[1].toArray().tolist() == [1.0, 0.0, 0.0] and sparse[4].toArray().tolist() == [0.0, 0.0, 9.0]


def test_assembled_names_follow_the_vector(mixed):
    encoder = OneHot.fit(mixed.filter("k is not null"), ["k"], ["v"])
    assert encoder.names == ["k_a", "k_b", "v"]


def test_clean_text(mixed):
    cleaned = values(mixed.withColumn("t", clean_text("t")), "t")
    assert cleaned[1] == "" and cleaned[2] == "x y" and cleaned[3] == "Don t stop"
    long = mixed.withColumn("t", clean_text(F.repeat(F.lit("w "), 300), max_words=200))
    assert len(values(long, "t")[1].split()) == 200


def test_tokens(spark):
    df = spark.createDataFrame([("Éte a bc_1, ZZ",)], "t string")
    assert df.select(tokens("t")).first()[0] == ["éte", "bc_1", "zz"]


def test_hash_split_is_complete_disjoint_and_stable(spark):
    df = spark.range(20000).withColumn("s", split_name("id"))
    shares = {r["s"]: r["count"] / 20000 for r in df.groupBy("s").count().collect()}
    assert shares["train"] == pytest.approx(0.81, abs=0.01) and shares["test"] == pytest.approx(0.10, abs=0.01)
    again = df.repartition(7).withColumn("s2", split_name("id"))
    assert again.filter("s <> s2").count() == 0


def test_exact_split_counts(spark):
    counts = {r["split"]: r["count"] for r in with_split(spark.range(1234), "id", seed=3, exact=True).groupBy("split").count().collect()}
    assert counts == {"test": 124, "validation": 111, "train": 999}


def test_subsample_keeps_exactly_the_smallest_hashes(spark):
    df = spark.range(30000)
    picked = {r["id"] for r in subsample(df, "id", 500, seed=1).collect()}
    from rowloom.functions.hashing import hash32

    ordered = df.orderBy(hash32(F.lit(1), "id"), "id").limit(500).collect()
    assert picked == {r["id"] for r in ordered}
    assert subsample(df, "id", 40000).count() == 30000


def test_batches_are_full_and_bounded(spark):
    df = assign_batches(spark.range(10000), "id", 64, epoch=2, rows_per_bucket=2000)
    sizes = [r["count"] for r in df.groupBy("batch_id").count().collect()]
    assert sorted(sizes) == [10000 % 64] + [64] * (10000 // 64)
    assert {r["batch_id"] for r in df.collect()} == set(range(157))
    assert df.select("batch_id", "pos").distinct().count() == 10000
    other = assign_batches(spark.range(10000).repartition(13), "id", 64, epoch=2, rows_per_bucket=2000)
    assert df.exceptAll(other).count() == 0


def test_range_starts_in_two_levels(spark):
    rng = random.Random(4)
    sizes = {b: rng.randint(1, 9) for b in rng.sample(range(500), 200)}
    found = {r["_bucket"]: r["_start"] for r in range_starts(spark.createDataFrame(list(sizes.items()), "_bucket long, count long"), 16).collect()}
    assert found == {b: sum(n for a, n in sizes.items() if a < b) for b in sizes}
    assert assign_batches(spark.range(0), "id", 8).collect() == []


def test_ranks_are_found_whatever_keys_repeat(spark):
    rng = random.Random(5)
    keys = ["hot"] * 400 + [f"k{rng.randrange(300)}" for _ in range(500)] + [None] * 90 + ["", "é", "z"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("_h", F.coalesce(hash32("k"), F.lit(0)) % 70_000 * 40)
    order = sorted(((r["_h"], r["k"]) for r in df.collect()), key=lambda r: (r[0], r[1] is not None, r[1]))
    ranks = [1, 17, 0, 450, 451, 991, 993]
    for direct in (0, 100, 10**6):  # with and without the step per whole hash
        assert _cuts(df, "k", lambda n: ranks, direct) == [order[r - 1] if r else None for r in ranks]
    split = with_split(df.select("k"), "k", exact=True).groupBy("k").agg(F.count_distinct("split").alias("n"), F.count("*").alias("rows"))
    assert {r["n"] for r in split.collect()} == {1} and split.agg(F.sum("rows")).first()[0] == len(keys)
    assert with_split(df.limit(0).select("k"), "k", exact=True).collect() == []
    assert subsample(df.select("k"), "k", 0).count() == 0 and subsample(df.select("k"), "k", len(keys)).count() == len(keys)


def test_union_named_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    rows = {r["source"]: r["y"] for r in ops.union_named({"a": a, "b": b}, "source").collect()}
    assert rows == {"a": 2, "b": None}


def test_recipe_runs_in_order(spark):
    rows = [(1, "3", "b", None, 5.0), (2, "8", "a", "Hi there!", None), (3, "0", "a", "x", 1.0)]
    df = spark.createDataFrame(rows, "row_id long, `the.n` string, k string, t string, age double")
    steps = (not_null("age"), sanitize(), rename_map({"the_n": "n"}), cast("double", "n"), log1p("n"), minmax("n"), codes("k"), clean("t"))
    out = {r["row_id"]: r for r in Recipe(steps).apply(df).collect()}
    assert set(out) == {1, 3} and out[1]["n"] == 1.0 and out[3]["n"] == 0.0
    assert out[1]["k"] == 1 and out[1]["t"] == ""


def test_coded_features_mark_unseen_levels(spark):
    from rowloom.plans.baseline import coded_features

    rows = [(1, "a", 2.0, "p", "train"), (2, "b", 3.0, "q", "train"), (3, "z", 4.0, "q", "test")]
    df = spark.createDataFrame(rows, "id long, k string, v double, y string, split string")
    out = {r["id"]: r for r in coded_features(df, DataCard("id", cat=["k", "y"], num=["v"], response="y")).collect()}
    assert out[2]["features"] == [1.0, 3.0] and out[2]["points"].toArray().tolist() == [0.0, 1.0, 3.0] and out[2]["target"] == 1.0
    assert out[3]["features"] == [-1.0, 4.0] and out[3]["points"].toArray().tolist() == [0.0, 0.0, 4.0]


def test_missing_numbers_are_filled_or_dropped(spark):
    from rowloom.plans.baseline import coded_features

    rows = [(1, "a", 1.0, 0, "train"), (2, "b", None, 1, "train"), (3, None, 3.0, 1, "test")]
    df = spark.createDataFrame(rows, "id long, k string, v double, y int, split string")
    full = {r["id"]: r["features"].toArray().tolist() for r in one_hot_sparse(df, ["k"], ["v"]).collect()}
    assert full == {1: [1.0, 0.0, 1.0], 2: [0.0, 1.0, 0.0], 3: [0.0, 0.0, 3.0]}
    assert {r["id"] for r in one_hot_sparse(df, ["k"], ["v"], missing="drop").collect()} == {1, 3}
    assert coded_features(df, DataCard("id", cat=["k", "y"], num=["v"], response="y")).count() == 3


def test_registry_names_every_dataset():
    assert len(DATASETS) == 49
    with pytest.raises(KeyError, match="airlines"):
        DATASETS["no such table"]


def test_every_card_lists_its_variables_and_levels():
    """Counts of the profile table; three wide tables leave one list to the table itself."""
    for name in DATASETS:
        card = DATASETS[name].card
        assert card.response is None or card.response in card.variables, name
        if REST not in card.variables:
            assert len(set(card.variables)) == sum(card.counts().values()), name
            assert not card.cat or set(card.levels) == set(card.cat), name
    assert {n for n in DATASETS if REST in DATASETS[n].card.variables} == {"mercedes", "bioresponse", "topo"}
    assert DATASETS["clothing"].card.levels["Division Name"] == 4 and DATASETS["compas"].card.counts() == {"num": 3, "cat": 9, "txt": 0, "dense": 0}


def test_null_is_the_last_level(spark):
    rows = [(i, [None, "General", "Petite"][i % 3], float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, `Division Name` string, v double")
    fitted = Recipe((codes("Division Name"),)).apply(df).collect()
    assert {r["id"] % 3: r["Division Name"] for r in fitted} == {0: 2, 1: 0, 2: 1}
    without = LevelCodes.fit(df.filter("id % 3 > 0"), ["Division Name"], null_level=True)
    with pytest.raises(Exception, match="without a code"):
        without.transform(df).collect()


def test_registered_recipe_prepares_a_table(spark):
    rows = [(i, f"{i % 2 + 1}", f"{i % 3}", 100.0 * i, 5.0, 700.0 + i, float(i)) for i in range(60)]
    names = "row_id long, Month string, DayofMonth string, CRSDepTime double, CRSArrTime double, Distance double, DepDelay double"
    df, card, _ = DATASETS["airlines"].prepare(spark.createDataFrame(rows, names))
    assert card.features == ["Month", "DayofMonth", "CRSDepTime", "CRSArrTime", "Distance"]
    bounds = df.agg(F.min("DepDelay"), F.max("DepDelay"), F.max("CRSArrTime"), F.max("Month"), F.max("DayofMonth")).first()
    assert tuple(bounds) == (0.0, 1.0, 0.0, 1, 2)


def test_presplit_recipe_fits_on_train(spark):
    rows = [(i, f"n{i}", "d", None, "no" if i % 2 else "yes", "US", "USD", i % 2, 10.0 ** (i % 4), i, 2 * i, "train" if i < 30 else "test") for i in range(40)]
    schema = ("row_id long, name string, desc string, keywords string, disable_communication string, country string, currency string, "
              "final_status int, goal double, deadline long, created_at long, split string")
    df, card, _ = DATASETS["kickstarter"].prepare(spark.createDataFrame(rows, schema))
    out = df.agg(F.max("deadline"), F.max("goal"), F.max("disable_communication"), F.first("keywords")).first()
    assert out[0] == pytest.approx(39 / 29) and out[1] == 1.0 and out[2] == 1 and out[3] == ""
    assert card.txt == ["name", "desc", "keywords"] and card.task == "classification"


def test_map_batches(spark):
    out = ops.map_batches(spark.range(10), lambda frame: frame.assign(twice=frame.id * 2), "id long, twice long")
    assert out.filter("twice <> 2 * id").count() == 0 and out.count() == 10
