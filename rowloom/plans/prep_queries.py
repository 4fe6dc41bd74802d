"""Preparation operators over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.cards import column_levels, level_check, profile
from rowloom.functions.hashing import hash32_sql, split_sql
from rowloom.functions.text import tokens
from rowloom.operators import columns as col_ops
from rowloom.operators import metrics
from rowloom.operators.encoding import LevelCodes, OneHot
from rowloom.operators.lookup import lookup_join
from rowloom.operators.sampling import assign_batches, assign_batches_sql, distinct_rows, subsample, with_split
from rowloom.operators.scaling import MinMax
from rowloom.plans import inputs
from rowloom.plans.inputs import CUSTOMERS_SQL, DOCUMENTS_SQL, ORDERS_SQL, PARTS_SQL, rounded, table
from rowloom.sources.grids import STANDARD
from rowloom.plans.recipe import Recipe, clean, codes, log1p, minmax

SAMPLE_ROWS = 5_000
BATCH_ROWS = 256
BUCKET_ROWS = 4_096


def rename_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    dotted = col_ops.rename(
        table(spark, folder, "part"), {"p_partkey": "part.key", "p_brand": "part.brand", "p_retailprice": "part.price"}
    )
    return col_ops.sanitize_names(dotted)


def cast_types(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer")
    df = col_ops.cast(df, {"c_custkey": "string", "c_nationkey": "double"})
    return col_ops.cast(df, {"c_name": "int"}, strict=False)


def filter_not_null(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    joined = table(spark, folder, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return col_ops.drop_missing(joined, "quality")


def log_transform(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("log10_balance"), F.col("c_acctbal").alias("log1p_balance"))
    df = col_ops.log1p(col_ops.log10(df, "log10_balance"), "log1p_balance")
    return df.select("c_custkey", rounded("log10_balance"), rounded("log1p_balance"))


def minmax_global(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.orders(spark, folder)
    names = ["o_totalprice", "order_month"]
    return MinMax.fit(df, names).transform(df).select("o_orderkey", *[rounded(n) for n in names])


def minmax_train_fit(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.parts(spark, folder)
    names = ["p_size", "p_retailprice"]
    return MinMax.fit(df, names, train_only=True).transform(df).select("p_partkey", "split", *[rounded(n) for n in names])


def card_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile(inputs.orders(spark, folder), inputs.ORDERS, "orders")


def card_levels(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.parts(spark, folder)
    fitted = LevelCodes.fit(df, inputs.PARTS.cat)
    return level_check(fitted.transform(df), inputs.PARTS.with_levels(fitted.sizes))


def level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return column_levels(inputs.orders(spark, folder), ["o_orderstatus", "o_orderpriority", "order_month"])


def ordinal_encode(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.parts(spark, folder).select("p_partkey", "p_brand", "p_type", "p_size")
    return LevelCodes.fit(df, ["p_brand", "p_type", "p_size"], order="lexical").transform(df)


def relabel_train_levels(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.customers(spark, folder).select("c_custkey", "split", "c_mktsegment", "c_nationkey")
    return LevelCodes.fit(df, ["c_mktsegment", "c_nationkey"], order="numeric", train_only=True, unseen="skip").transform(df)


def one_hot_ignore(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.orders(spark, folder)
    encoded = OneHot.fit(df, ["o_orderstatus", "o_orderpriority"], []).transform(df, "vector")
    digits = F.transform("vector", lambda x: x.cast("int").cast("string"))
    return encoded.select("o_orderkey", F.array_join(digits, ",").alias("indicators"))


def assemble_features(spark: SparkSession, folder: str) -> DataFrame:
    df = inputs.parts(spark, folder)
    df = OneHot.fit(df, ["p_brand", "p_type"], ["p_size"]).transform(df)
    return df.select(
        "p_partkey",
        F.size("features").cast("long").alias("width"),
        F.array_position("features", F.lit(1.0)).cast("long").alias("first_hot"),
        F.aggregate("features", F.lit(0.0), lambda t, x: t + x).alias("total"),
        F.element_at("features", -1).alias("last_value"),
    )


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "documents").select("doc_id", "text")
    return Recipe((clean("text"),)).apply(df)


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    df = with_split(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").filter(F.col("split") == "train")
    words = df.select(F.explode(tokens("text")).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.orders(spark, folder).select("o_orderkey", "split")


def subsample_rows(spark: SparkSession, folder: str) -> DataFrame:
    train = inputs.orders(spark, folder).filter(F.col("split") == "train").select("o_orderkey", "o_totalprice")
    return subsample(train, "o_orderkey", SAMPLE_ROWS)


def distinct_features(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_rows(inputs.orders(spark, folder), "o_orderstatus", "o_orderpriority", "order_month")


def batch_assign(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").select("o_orderkey")
    return assign_batches(df, "o_orderkey", BATCH_ROWS, epoch=1, rows_per_bucket=BUCKET_ROWS)


def _parties(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), "c_mktsegment", F.col("c_acctbal").alias("balance"))
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), "s_name", F.col("s_acctbal").alias("balance"))
    return {"customer": customer, "supplier": supplier}


def named_splits(spark: SparkSession, folder: str) -> DataFrame:
    sides = {name: df.select("key", "nation", "balance") for name, df in _parties(spark, folder).items()}
    return col_ops.union_named(sides, "split")


def union_missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    return col_ops.union_named(_parties(spark, folder), "party").drop("balance")


def feature_response(spark: SparkSession, folder: str) -> DataFrame:
    card, df = inputs.PARTS, inputs.parts(spark, folder)
    return df.select(card.key, *card.features, card.response)


def column_functions(spark: SparkSession, folder: str) -> DataFrame:
    """A mapping from columns to expressions, applied to a table."""
    df = table(spark, folder, "events").select("event_id", "event_type", "value")
    return col_ops.apply_functions(df, {"event_type": F.upper, "value": lambda v: F.round(F.sqrt(v), 6)})


def lookup_names(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return lookup_join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), nations, ["s_nationkey"])


def prepared_documents(spark: SparkSession, folder: str) -> DataFrame:
    steps = (clean("text"), codes("lang", "source", train_only=True, unseen="null"), log1p("n_chars"), minmax("n_chars", train_only=True))
    df = Recipe(steps).apply(inputs.documents(spark, folder))
    return df.select("doc_id", "split", "lang", "source", rounded("n_chars"), F.length("text").cast("long").alias("clean_chars"))


def codes_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """A label that covers some documents only: null is a level of its own, after the others."""
    df = inputs.documents(spark, folder).select("doc_id", "quality")
    return LevelCodes.fit(df, ["quality"], order="numeric", null_level=True).transform(df)


def exact_split(spark: SparkSession, folder: str) -> DataFrame:
    return with_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", exact=True)


def one_hot_error(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of the whole table, so that the policy for values outside them finds none."""
    df = inputs.orders(spark, folder)
    encoded = OneHot.fit(df, ["o_orderstatus", "o_orderpriority"], [], train_only=False, unseen="error").transform(df, "vector")
    digits = F.transform("vector", lambda x: x.cast("int").cast("string"))
    return encoded.select("o_orderkey", F.array_join(digits, ",").alias("indicators"))


def rounded_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A numeric guess of the size class, the mean of its brand, to the nearest class."""
    df = table(spark, folder, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("size_class"))
    return metrics.rounded_labels(df, "size_class")


def sweep_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of a grid beside the profile of the table that it is to run on."""
    one = profile(inputs.parts(spark, folder), inputs.PARTS, "part").select(F.lit(0).alias("_one"), "name", "samples", "variables")
    grid = STANDARD.table(spark).withColumn("_one", F.lit(0))
    return grid.join(F.broadcast(one), "_one").drop("_one")


QUERIES = {
    "codes_with_nulls": codes_with_nulls,
    "exact_split": exact_split,
    "one_hot_error": one_hot_error,
    "rounded_labels": rounded_labels,
    "sweep_grid": sweep_grid,
    "rename_sanitize": rename_sanitize,
    "cast_types": cast_types,
    "filter_not_null": filter_not_null,
    "log_transform": log_transform,
    "minmax_global": minmax_global,
    "minmax_train_fit": minmax_train_fit,
    "card_profile": card_profile,
    "card_levels": card_levels,
    "level_counts": level_counts,
    "ordinal_encode": ordinal_encode,
    "relabel_train_levels": relabel_train_levels,
    "one_hot_ignore": one_hot_ignore,
    "assemble_features": assemble_features,
    "clean_text": clean_text,
    "token_counts": token_counts,
    "hash_split": hash_split,
    "subsample": subsample_rows,
    "distinct_rows": distinct_features,
    "batch_assign": batch_assign,
    "named_splits": named_splits,
    "union_missing_columns": union_missing_columns,
    "feature_response": feature_response,
    "column_functions": column_functions,
    "lookup_names": lookup_names,
    "prepared_documents": prepared_documents,
}


def _scaled_sql(name: str, relation: str, where: str = "TRUE", digits: int = 6) -> str:
    low = f"(SELECT min({name}) FROM {relation} WHERE {where})"
    high = f"(SELECT max({name}) FROM {relation} WHERE {where})"
    return f"round(CASE WHEN {high} > {low} THEN ({name} - {low}) / ({high} - {low}) ELSE CAST({name} - {low} AS DOUBLE) END, {digits})"


_CLEAN = "trim(regexp_replace(coalesce(text, ' '), '[^a-zA-Z0-9]+', ' ', 'g'))"


def _codes_sql(column: str, relation: str, order: str, where: str = "TRUE") -> str:
    return (f"(SELECT {column} AS level, row_number() OVER (ORDER BY {order}) - 1 AS code "
            f"FROM (SELECT DISTINCT {column} FROM {relation} WHERE {where} AND {column} IS NOT NULL))")


_H = hash32_sql("o_orderkey")
_GRID_SQL = ", ".join(
    f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {name}) AS g{i}" for i, (name, values) in enumerate((
        ("replicate", range(STANDARD.replicates)), ("batch_size", STANDARD.batch_sizes), ("learning_rate", STANDARD.learning_rates),
        ("latent_dim", STANDARD.latent_dims), ("method", STANDARD.methods),
    ))
)

ORACLES = {
    "codes_with_nulls": """SELECT doc_id, CASE WHEN quality IS NULL THEN (SELECT count(DISTINCT quality) FROM labels)
        ELSE (SELECT count(DISTINCT o.quality) FROM labels o WHERE o.quality < l.quality) END AS quality
        FROM documents LEFT JOIN labels l USING (doc_id)""",
    "exact_split": f"""WITH n AS (SELECT count(*) AS n, CAST(ceil(0.1 * count(*)) AS BIGINT) AS test FROM orders),
        r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_H}, o_orderkey) AS r FROM orders)
        SELECT o_orderkey, CASE WHEN r <= test THEN 'test' WHEN r <= test + CAST(ceil(0.1 * (n - test)) AS BIGINT) THEN 'validation' ELSE 'train' END AS split FROM r, n""",
    "one_hot_error": """WITH s AS (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS l FROM orders),
        p AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS l FROM orders)
        SELECT o_orderkey, array_to_string(list_concat(
            list_transform(s.l, lambda x: CASE WHEN x = o_orderstatus THEN '1' ELSE '0' END),
            list_transform(p.l, lambda x: CASE WHEN x = o_orderpriority THEN '1' ELSE '0' END)), ',') AS indicators
        FROM orders, s, p""",
    "rounded_labels": "SELECT p_brand, CAST(round(round(avg(p_size), 6)) AS INTEGER) AS size_class FROM part GROUP BY p_brand",
    "sweep_grid": f"""SELECT replicate, batch_size, learning_rate, latent_dim, method, 'part' AS name,
        (SELECT count(*) FROM part) AS samples, CAST({len(inputs.PARTS.variables)} AS BIGINT) AS variables FROM {_GRID_SQL}""",
    "rename_sanitize": """SELECT p_partkey AS part_key, p_name, p_brand AS part_brand, p_type, p_size,
        p_retailprice AS part_price FROM part""",
    "cast_types": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, TRY_CAST(c_name AS INTEGER) AS c_name,
        CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
    "filter_not_null": "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
    "log_transform": """SELECT c_custkey,
        CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS log10_balance,
        CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 6) END AS log1p_balance FROM customer""",
    "minmax_global": f"""SELECT o_orderkey, {_scaled_sql('o_totalprice', ORDERS_SQL)} AS o_totalprice,
        {_scaled_sql('order_month', ORDERS_SQL)} AS order_month FROM {ORDERS_SQL}""",
    "minmax_train_fit": f"""SELECT p_partkey, split, {_scaled_sql('p_size', PARTS_SQL, "split = 'train'")} AS p_size,
        {_scaled_sql('p_retailprice', PARTS_SQL, "split = 'train'")} AS p_retailprice FROM {PARTS_SQL}""",
    "card_profile": """SELECT 'orders' AS name, 'classification' AS task, count(*) AS samples, CAST(2 AS BIGINT) AS num_variables,
        CAST(2 AS BIGINT) AS cat_variables, CAST(0 AS BIGINT) AS txt_variables, CAST(0 AS BIGINT) AS dense_variables,
        CAST(4 AS BIGINT) AS variables FROM orders""",
    "card_levels": """SELECT 'p_brand' AS variable, count(DISTINCT p_brand) - 1 AS max_code, count(DISTINCT p_brand) AS levels, TRUE AS fits FROM part
        UNION ALL SELECT 'p_type', count(DISTINCT p_type) - 1, count(DISTINCT p_type), TRUE FROM part""",
    "level_counts": f"""SELECT 'o_orderstatus' AS variable, count(DISTINCT o_orderstatus) AS levels FROM orders
        UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
        UNION ALL SELECT 'order_month', count(DISTINCT order_month) FROM {ORDERS_SQL}""",
    "ordinal_encode": """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand,
        dense_rank() OVER (ORDER BY p_type) - 1 AS p_type,
        dense_rank() OVER (ORDER BY CAST(p_size AS VARCHAR)) - 1 AS p_size FROM part""",
    "relabel_train_levels": f"""SELECT c.c_custkey, c.split, s.code AS c_mktsegment, n.code AS c_nationkey FROM {CUSTOMERS_SQL} c
        JOIN {_codes_sql('c_mktsegment', CUSTOMERS_SQL, 'c_mktsegment', "split = 'train'")} s ON c.c_mktsegment = s.level
        JOIN {_codes_sql('c_nationkey', CUSTOMERS_SQL, 'c_nationkey', "split = 'train'")} n ON c.c_nationkey = n.level""",
    "one_hot_ignore": f"""WITH s AS (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS l FROM {ORDERS_SQL} WHERE split = 'train'),
        p AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS l FROM {ORDERS_SQL} WHERE split = 'train')
        SELECT o_orderkey, array_to_string(list_concat(
            list_transform(s.l, lambda x: CASE WHEN x = o_orderstatus THEN '1' ELSE '0' END),
            list_transform(p.l, lambda x: CASE WHEN x = o_orderpriority THEN '1' ELSE '0' END)), ',') AS indicators
        FROM orders, s, p""",
    "assemble_features": f"""WITH t AS (SELECT * FROM {PARTS_SQL} WHERE split = 'train'),
        b AS {_codes_sql('p_brand', 't', 'p_brand')}, k AS {_codes_sql('p_type', 't', 'p_type')}
        SELECT p_partkey, (SELECT count(*) FROM b) + (SELECT count(*) FROM k) + 1 AS width,
          CASE WHEN b.code IS NOT NULL THEN b.code + 1 WHEN k.code IS NOT NULL THEN (SELECT count(*) FROM b) + k.code + 1
               WHEN p_size = 1 THEN (SELECT count(*) FROM b) + (SELECT count(*) FROM k) + 1 ELSE 0 END AS first_hot,
          CAST((b.code IS NOT NULL)::INT + (k.code IS NOT NULL)::INT + p_size AS DOUBLE) AS total,
          CAST(p_size AS DOUBLE) AS last_value
        FROM part LEFT JOIN b ON p_brand = b.level LEFT JOIN k ON p_type = k.level""",
    "clean_text": f"SELECT doc_id, {_CLEAN} AS text FROM documents",
    "token_counts": f"""SELECT token, count(*) AS n FROM (
          SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token
          FROM documents WHERE {split_sql('doc_id')} = 'train') GROUP BY token""",
    "hash_split": f"SELECT o_orderkey, {split_sql('o_orderkey')} AS split FROM orders",
    "subsample": f"""SELECT o_orderkey, o_totalprice FROM {ORDERS_SQL} WHERE split = 'train'
        ORDER BY {hash32_sql('0', 'o_orderkey')}, o_orderkey LIMIT {SAMPLE_ROWS}""",
    "distinct_rows": f"SELECT DISTINCT o_orderstatus, o_orderpriority, order_month FROM {ORDERS_SQL}",
    "batch_assign": f"SELECT o_orderkey, batch_id, pos FROM {assign_batches_sql('orders', 'o_orderkey', BATCH_ROWS, 1)}",
    "named_splits": """SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance, 'customer' AS split FROM customer
        UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'supplier' FROM supplier""",
    "union_missing_columns": """SELECT c_custkey AS key, c_nationkey AS nation, c_mktsegment, NULL AS s_name, 'customer' AS party FROM customer
        UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_name, 'supplier' FROM supplier""",
    "feature_response": "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part",
    "column_functions": "SELECT event_id, upper(event_type) AS event_type, round(sqrt(value), 6) AS value FROM events",
    "lookup_names": "SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "prepared_documents": f"""WITH d AS (SELECT doc_id, split, lang, source, ln(1 + n_chars) AS n_chars, {_CLEAN} AS text FROM {DOCUMENTS_SQL})
        SELECT d.doc_id, d.split, l.code AS lang, s.code AS source,
          {_scaled_sql('n_chars', 'd', "split = 'train'")} AS n_chars, length(text) AS clean_chars
        FROM d LEFT JOIN {_codes_sql('lang', 'd', 'lang', "split = 'train'")} l ON d.lang = l.level
        LEFT JOIN {_codes_sql('source', 'd', 'source', "split = 'train'")} s ON d.source = s.level""",
}
