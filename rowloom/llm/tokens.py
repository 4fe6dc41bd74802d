"""Token counts from pieces per distinct pre-token and pre-token frequencies per document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import Scratch
from rowloom.llm.pretokens import pre_tokens

#: The head: at most so many pre-tokens of so many characters, chosen from a sample of about so many documents.
HEAD, HEAD_CHARS, SAMPLE = 100_000, 64, 8_000
FLUSH = 500_000


def _flush(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pre_token", "n"])


def frequencies(texts: DataFrame, text: str, path: str) -> DataFrame:
    """Rows (pre_token, n) of partial frequencies, flushed at a bounded number of distinct pre-tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = pre_tokens(path), Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for segment in split.segments(value or "")[::2]:
                    counts.update(split.split(segment))
                if len(counts) > FLUSH:
                    yield _flush(counts)
                    counts = Counter()
        yield _flush(counts)

    return texts.select(text).mapInArrow(count, "pre_token string, n long")


def pieces(pre: DataFrame, path: str) -> DataFrame:
    """Adds ``pieces``, the number of tokens of each pre-token on its own, by the library."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pre_tokens(path).library
        for batch in batches:
            found = [len(e) for e in library.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["pre_token", "pieces"])

    return pre.select("pre_token").mapInArrow(count, "pre_token string, pieces long")


def token_counts(docs: DataFrame, key: str, text: str, path: str, head: int = HEAD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: the key, n_bytes and n_tokens, without ids of any document.

    Each document becomes its pre-token frequencies. The head, frequent pre-tokens of a bounded sample with their
    pieces, is sent to every task and summed there, so no hot pre-token is shuffled; it decides where a pre-token is
    joined, never the result. The other pre-tokens are shuffled once: each distinct one is counted once by the library
    and joined to the frequencies, which are then summed per document. Special strings count as one token each.
    Null texts count as empty; both have 0 tokens. Repeated rows are counted apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    share = min(1.0, sample / max(1, docs.count()))
    common = frequencies(rows.sample(share, seed=1), "_text", path).filter(F.length("pre_token") <= HEAD_CHARS)
    common = common.groupBy("pre_token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre_token").limit(head)
    known = spark.sparkContext.broadcast({r[0]: r[1] for r in pieces(common, path).collect()})
    schema = "_row long, _key " + rows.schema["_key"].dataType.simpleString() + ", n_bytes long, head long, tail array<struct<pre_token:string,n:int>>"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cost = pre_tokens(path), known.value
        for batch in batches:
            sizes, heads, ends, names, times = [], [], [0], [], []
            for value in batch.column(2).to_pylist():
                value = value or ""
                cut = split.segments(value)
                total = len(cut) // 2
                counts = Counter(split.split(cut[0]))
                for segment in cut[2::2]:
                    counts.update(split.split(segment))
                for name, n in counts.items():
                    k = cost.get(name)
                    if k is None:
                        names.append(name)
                        times.append(n)
                    else:
                        total += k * n
                heads.append(total)
                ends.append(len(names))
                sizes.append(len(value.encode()))
            tail = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int32())], ["pre_token", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(heads, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)],
                ["_row", "_key", "n_bytes", "head", "tail"],
            )

    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), "_key", "_text")
    spreads = scratch.keep(numbered.mapInArrow(spread, schema), "frequencies")
    tails = spreads.select("_row", F.inline("tail")).repartition("pre_token")
    counted = pieces(tails.groupBy("pre_token").agg(F.lit(1)), path)
    sums = tails.join(counted, "pre_token").groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    return spreads.drop("tail").join(sums, "_row", "left").select(
        F.col("_key").alias(key), "n_bytes", (F.col("head") + F.coalesce("rest", F.lit(0))).alias("n_tokens")
    )
