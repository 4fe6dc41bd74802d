"""A training corpus in five stages: quality, exact and near duplicates, mixing, tokenising."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bpe, exact, mixing, near, quality
from rowloom.llm.common import Scratch
from rowloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the importance sample takes; labels come from the folder."""
    return quality.filtered(docs, spark.read.parquet(f"{folder}/labels.parquet")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of texts that are equal without white space, one."""
    return exact.deduplicated(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest key."""
    return near.deduplicated(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Whole documents that the mix serves, each as often as it is served; documents without words are in no mix."""
    return mixing.mixed(docs, "doc_id", "source", mixing.word_count("text")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, "doc_id", "text", tokenizer_path())


#: Quality: n-gram models; exact: extendible-hash index; near: SuperMinHash; mix: fair queueing; tokens: segment tree.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: SQL has neither the fitted models nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
