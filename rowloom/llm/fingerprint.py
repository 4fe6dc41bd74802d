"""Threshold-scaled fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import words

SHINGLE = 5
#: One shingle hash in so many is kept.
SCALE = 4
LOWEST = -(1 << 63)
#: Ranges of keys; their bounds are quantiles, and the rows of one range meet in one window.
RANGES, ROWS_PER_RANGE = 4096, 1000


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below 2^64 / scale (in signed order), and always the smallest hash.

    A text with fewer words than a shingle is one shingle; one without words, or null, has an empty sketch. Sketches
    merge: the union of two, cut at the fraction or else to the smallest hash, is the sketch of the joined sets.
    """
    return F.transform(F.array(words(text)), lambda w: _kept(w, shingle, scale))[0]


def _kept(w: Column, shingle: int, scale: int) -> Column:
    last = F.size(w) - shingle
    hashes = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
        last < 0, F.array(F.xxhash64(w))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)])))
    bound = LOWEST + (1 << 64) // scale
    return F.transform(
        F.array(hashes), lambda h: F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < bound), F.array_compact(F.array(F.array_min(h))))))
    )[0]


def as_text(hashes: Column) -> Column:
    """16 hexadecimal digits a hash, in order."""
    return F.concat_ws("", F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches; 1 for two empty ones."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / together)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s hashes in ``b``; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, _range, _guest) such that the next row of each, by descending key, is in its window.

    Keys are cut into ranges at quantiles; the first row of each range is added as a guest to the range before it,
    and the first of all to the last range. Texts are shuffled once.
    """
    place = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    keys = docs.select(place.alias("_place"))
    ranges = min(RANGES, max(1, keys.count() // ROWS_PER_RANGE))
    fine = max(1, round(ranges ** 0.5))
    shares = [i / ranges for i in range(1, ranges)]
    found = keys.agg(F.percentile_approx("_place", shares, 10 * RANGES)).first()[0] if shares else []
    bounds = sorted(set(found or []))
    chunks = [bounds[i:i + fine] for i in range(0, len(bounds), fine)]

    def range_of(p: Column) -> Column:
        """Number of bounds below the place, by chunk and then within the chunk."""
        if not chunks:
            return F.lit(0)
        ends = F.array(*[F.lit(c[-1]).cast("long") for c in chunks])
        chunk = F.size(F.filter(ends, lambda b: b < p))
        inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in c]) for c in chunks])
        inside = F.size(F.filter(F.coalesce(F.get(inner, chunk), F.array().cast("array<bigint>")), lambda b: b < p))
        return (F.least(chunk * fine, F.lit(len(bounds))) + inside).cast("int")

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), place.alias("_place"))
    rows = rows.withColumn("_range", range_of(F.col("_place")))
    heads = keys.groupBy(range_of(F.col("_place")).alias("_own")).agg(F.max("_place").alias("_place"))
    before = Window.orderBy(F.col("_own").desc())  # one row per range
    everything = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_place", F.coalesce(F.lag("_own").over(before), F.min("_own").over(everything)).alias("_host"))
    guests = rows.join(F.broadcast(heads), "_place", "left")
    places = F.array_compact(F.array(F.struct("_range", F.lit(False).alias("_guest")), F.when(F.col("_host").isNotNull(), F.struct(F.col("_host").alias("_range"), F.lit(True).alias("_guest")))))
    return guests.withColumn("_at", F.explode(places)).select(key, "text", "_place", "_at.*")


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likenesses.

    The edited text has its last third of code points replaced by the first as many (or all) of the next document's,
    by descending key; null keys come last, and equal keys go by text. After the last document comes the first, so a
    table of one row follows itself. Null texts count as empty.
    """
    rows = with_next(docs, key, text)
    order = Window.partitionBy("_range").orderBy(F.col("_guest"), F.col("_place").desc(), F.col("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("_next", F.lead("text").over(order)).withColumn("n_chars", F.length("text"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring("_next", F.lit(1), third))
    rows = rows.withColumn("_edited", edited).withColumn("_sketch", sketch(F.col("text"), shingle, scale))
    rows = rows.withColumn("_next_sketch", F.lead("_sketch").over(order)).filter("NOT _guest")
    rows = rows.withColumn("_edited_sketch", sketch(F.col("_edited"), shingle, scale))
    own, other, after = F.col("_sketch"), F.col("_edited_sketch"), F.col("_next_sketch")
    return rows.select(
        key, F.col("n_chars").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"), as_text(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"),
        containment(own, other).alias("in_edited"), containment(own, after).alias("in_next"),
    )
