"""The given tables as prepared inputs, with their cards and the matching SQL relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.cards import DataCard
from rowloom.functions.hashing import split_sql
from rowloom.functions.vectors import doubles
from rowloom.operators.sampling import with_split
from rowloom.sources.tables import read_table

ORDERS = DataCard("o_orderkey", cat=["o_orderstatus", "o_orderpriority"], num=["o_totalprice", "order_month"], response="o_orderstatus")
PARTS = DataCard("p_partkey", cat=["p_brand", "p_type"], num=["p_size", "p_retailprice"], response="p_retailprice")
CUSTOMERS = DataCard("c_custkey", cat=["c_mktsegment", "c_nationkey"], num=["c_acctbal"], response="c_mktsegment")
EMBEDDINGS = DataCard("vec_id", dense=["embedding"], cat=["label"], response="label")
DOCUMENTS = DataCard("doc_id", txt=["text"], cat=["lang", "source", "quality"], num=["n_chars"], response="quality")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").withColumn("order_month", F.month("o_orderdate"))
    return with_split(ORDERS.select(df), "o_orderkey")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return with_split(PARTS.select(table(spark, folder, "part")), "p_partkey")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return with_split(CUSTOMERS.select(table(spark, folder, "customer")), "c_custkey")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "embeddings").select("vec_id", "label", doubles("embedding").alias("embedding"))
    return with_split(df, "vec_id")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents; quality is null where no label covers them."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    joined = table(spark, folder, "documents").join(labels, "doc_id", "left")
    return with_split(DOCUMENTS.select(joined), "doc_id")


ORDERS_SQL = f"""(SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
  CAST(month(o_orderdate) AS INTEGER) AS order_month, {split_sql('o_orderkey')} AS split FROM orders)"""
PARTS_SQL = f"(SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, {split_sql('p_partkey')} AS split FROM part)"
CUSTOMERS_SQL = f"(SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, {split_sql('c_custkey')} AS split FROM customer)"
EMBEDDINGS_SQL = f"(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding, {split_sql('vec_id')} AS split FROM embeddings)"
DOCUMENTS_SQL = f"""(SELECT doc_id, text, lang, source, quality, n_chars, {split_sql('doc_id')} AS split
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id))"""


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)
