"""Toxicity by a string-subsequence kernel machine over sentences, with Nystroem landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import Scratch

#: Subsequences of so many characters, each skipped or spanned character costing the decay.
ORDER, DECAY = 3, 0.75
LANDMARKS = 160
#: A document is judged by so many of its worst sentences.
WORST = 3
#: Strengths are this power of the kernel, a kernel too; below MEETS they count as 0. The least kernel of a landmark of four
#: letters, none of them more than twice in it, is 0.348 with one missing and 0.48 with a character inserted.
POWER, MEETS = 4, 0.34
#: A landmark meets windows of its length and so many inserted characters.
SLACK = 2
#: The machine is trained on at most so many labelled documents of each class, taken by key hash.
TOXIC, CLEAN = 4_000, 8_000
GRAM_SIZES = (4, 5, 6)
#: Standard errors by which a landmark must be more frequent in toxic documents.
CLEAR = 4
#: Blanks after a mark end a sentence, unless the next piece is a single letter with such a mark: one more letter spelled out.
SENTENCE = re.compile(r"(?<=[.!?])\s++(?![.\-_*]*[^\W_][.\-_*]*[.!?](?:\s|$))|\n+")
CLEANED = re.compile(r"[\W_]+")
#: Three or more single letters with blanks or marks between them: a word spelled out.
SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[\s.\-_*]+[^\W_](?![^\W_])){2,}")
#: What every match of SPELLED holds, its second and third letter, and is found sooner.
LONE = re.compile(r"[\s.\-_*][^\W_][\s.\-_*]+[^\W_](?![^\W_])")
#: Words, and windows, compared at a time: few enough for a processor's cache.
TOGETHER, WINDOWS = 8_192, 2_048
#: Words a worker remembers; then it starts afresh. Longer words are met in pieces that start every LONGEST characters.
REMEMBERED, LONGEST = 1_000_000, 32
#: What a met word counts with, besides its letters, when it is sent to every worker.
ENTRY_BYTES = 120
THRESHOLD = 0.3


def sentence_words(sentence: str) -> list[str]:
    """Lower-cased pieces between blanks, and the spelled-out words."""
    low = sentence.lower()
    words = low.split()
    if LONE.search(low):
        words += [CLEANED.sub("", m[0]) for m in SPELLED.finditer(low)]
    return words


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s]


def subsequence_kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted kernel of each row of ``left`` with its row of ``right`` (or the one row there is); -1 pads.

    A common subsequence weighs the decay to the power of both its spans, which depends on its first and last match only.
    So ``sums[p]`` holds, for each place of ``right``, the weights of the first matches of the common subsequences of p
    characters before that place and before the current character of ``left``.
    """
    n, m = left.shape[1], right.shape[1]
    rows = max(left.shape[0], right.shape[0])
    lefts, rights = np.ascontiguousarray(np.where(left < 0, -2, left).T), np.ascontiguousarray(right.T)
    place = decay ** np.arange(m)
    begun = 1 / place[:, None]
    sums = np.zeros((order, m + 1, rows))
    total = np.zeros(rows)
    for i in range(n):
        same = lefts[i] == rights
        # a match that is number p needs p characters before it and order - 1 - p after it, on both sides
        for p in range(min(i, order - 1), max(0, order - n + i) - 1, -1):
            part = slice(p, max(p, m - (order - 1 - p)))
            found = same[part] * (sums[p, part] if p else begun[part] * decay ** -i)
            if p == order - 1:
                total += (place[part] @ found) * decay ** (i + 2)
            else:
                for j in range(1, len(found)):
                    found[j] += found[j - 1]
                sums[p + 1, p + 1:p + 1 + len(found)] += found
    return total


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words, padded with -1."""
    padded = "".join([w[:width].ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
    out = np.frombuffer(padded, np.int32).reshape(len(words), width)
    return np.where(out == 0, -1, out)


def pair_bits(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One bit of 64 for each pair of characters; no bit where one is padding."""
    bit = np.uint64(1) << ((first.astype(np.uint64) * np.uint64(31) + second.astype(np.uint64) * np.uint64(7)) & np.uint64(63))
    return np.where((first >= 0) & (second >= 0), bit, np.uint64(0))


def masks(rows: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit sets of each row's characters, and of its pairs with fewer than ``reach`` characters between them."""
    letters = np.bitwise_or.reduce(pair_bits(rows, rows), axis=1)
    pairs = np.zeros(len(rows), np.uint64)
    for gap in range(1, reach + 1):
        pairs |= np.bitwise_or.reduce(pair_bits(rows[:, :-gap], rows[:, gap:]), axis=1, initial=np.uint64(0))
    return letters, pairs


def strength(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of words with landmarks (words x landmarks), 0 to 1: the best window of the word that starts at one of the
    landmark's first two letters, both sides normalised, to the power POWER.

    It is 0 where more than one of the landmark's letters, or more than a third of its neighbouring pairs and more than
    the two of one letter (with up to SLACK characters inserted), are missing, so most words cost two bit tests. Words of
    about the same length are met together.
    """
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not landmarks:
        return out
    marks = [(m, codes([m], len(m))) for m in landmarks]
    needs = [(masks(mark, 1)[0][0], masks(mark, 1)[1][0]) for _, mark in marks]
    by_length: dict[int, list[int]] = {}
    for k, landmark in enumerate(landmarks):
        by_length.setdefault(len(landmark), []).append(k)
    sides = {n: codes([m if len(m) == n else "" for m in landmarks], n) for n in by_length}
    norms = {n: subsequence_kernel(side, side) for n, side in sides.items()}
    reach = max(by_length) + SLACK  # a piece holds the whole windows that start in its first part
    pieces, owner = [], []
    for i, w in enumerate(words):
        for a in range(0, max(1, len(w)), LONGEST):
            pieces.append(w[a:a + LONGEST + reach])
            owner.append(i)
    order = np.argsort(np.fromiter(map(len, pieces), np.int64, len(pieces)), kind="stable")
    owner = np.array(owner, np.int64)[order]
    for begin in range(0, len(order), TOGETHER):
        part, own = [pieces[i] for i in order[begin:begin + TOGETHER].tolist()], owner[begin:begin + TOGETHER]
        starts = min(LONGEST, len(part[-1]))
        rows = codes(part, starts + reach)
        single = pair_bits(rows, rows)
        letters, pairs = (~m for m in masks(rows, SLACK + 1))
        for length, kinds in by_length.items():
            found = []
            for k in kinds:
                (landmark, mark), (need_letters, need_pairs) = marks[k], needs[k]
                near = np.flatnonzero(np.bitwise_count(need_letters & letters) <= 1)
                missing = np.bitwise_count(need_pairs & pairs[near])
                near = near[missing <= max(2, (len(landmark) - 1) // 3)]
                # the best window starts at the landmark's first letter, or at its second if the first is missing
                first = rows[near, :starts]
                at, start = np.nonzero((first == mark[0, 0]) | (first == mark[0, min(1, length - 1)]))
                found.append((np.full(len(at), k), near[at], start))
            kind, piece, start = (np.concatenate(c) for c in zip(*found))
            windows, bits = (np.lib.stride_tricks.sliding_window_view(x, length + SLACK, axis=1) for x in (rows, single))
            side, norm = sides[length], norms[length]
            needed = np.array([letter for letter, _ in needs])
            for at in range(0, len(kind), 4 * WINDOWS):
                k, where, begins = (x[at:at + 4 * WINDOWS] for x in (kind, piece, start))
                lacking = np.bitwise_count(needed[k] & ~np.bitwise_or.reduce(bits[where, begins], axis=1))
                few = np.flatnonzero(lacking <= 1)
                for cut in range(0, len(few), WINDOWS):
                    some = few[cut:cut + WINDOWS]
                    meet(k[some], own[where[some]], windows[where[some], begins[some]], side, norm, out)
    return out


def meet(k: np.ndarray, own: np.ndarray, texts: np.ndarray, side: np.ndarray, norm: np.ndarray, out: np.ndarray) -> None:
    """Raise the strengths of words ``own`` with landmarks ``k`` to those of their windows."""
    cross = subsequence_kernel(side[k], texts)
    # a text's own kernel is at least that of as many different letters, so few need theirs
    sizes = (texts >= 0).sum(axis=1)
    near = np.flatnonzero(cross >= MEETS * np.sqrt(norm[k] * least_norms(texts.shape[1])[sizes]))
    if near.size:
        texts, k, own = texts[near], k[near], own[near]
        value = cross[near] / np.sqrt(norm[k] * subsequence_kernel(texts, texts))
        np.maximum.at(out, (own, k), np.where(value >= MEETS, value ** POWER, 0).astype(np.float32))


@lru_cache
def least_norms(most: int) -> np.ndarray:
    """The kernel of a text of 0 to ``most`` different letters with itself."""
    texts = np.where(np.arange(most) < np.arange(most + 1)[:, None], np.arange(most), -1)
    return np.maximum(subsequence_kernel(texts, texts), 1e-12)


@dataclass
class Machine:
    landmarks: list[str]
    basis: np.ndarray
    weights: np.ndarray
    curve: np.ndarray

    def pulls(self, strengths: np.ndarray) -> np.ndarray:
        """What each row of strengths adds to a margin; rows are summed one by one, so that none depends on its neighbours."""
        return (strengths.astype(float) * (self.basis @ self.weights[:-1])).sum(axis=1)

    def worst(self, pulls: np.ndarray | list[float]) -> np.ndarray:
        """The WORST greatest margins of sentences; sentences that meet no landmark stand in for absent ones."""
        return np.sort(np.append(pulls, np.zeros(WORST)))[::-1][:WORST] + self.weights[-1]

    def score(self, pulls: np.ndarray | list[float]) -> float:
        """0 to 1 for the sentences of a document."""
        return float(logistic(np.append(self.worst(pulls), 1.0) @ self.curve))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Meter:
    """Landmark strengths of texts; words are met once and only those that any landmark meets are remembered with it."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.seen: set[str] = set()
        self.hits: dict[str, np.ndarray] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.hits.clear()
        fresh = [w for w in words if w not in self.seen]
        if not fresh:
            return
        found = strength([CLEANED.sub("", w) for w in fresh], self.landmarks)
        for i in np.flatnonzero(found.any(axis=1)).tolist():
            self.hits[fresh[i]] = found[i]
        self.seen.update(fresh)

    def features(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the strengths (sentences x landmarks) of the sentences that any landmark meets; maybe no row."""
        split = [[sentence_words(s) for s in sentences(t)] for t in texts]  # what is learned is what is looked up
        self.learn({w for rows in split for words in rows for w in words})
        out = []
        for found in split:
            rows = []
            for words in found:
                met = [self.hits[w] for w in words if w in self.hits]
                if met:
                    rows.append(np.sum(met, axis=0))
            out.append(np.array(rows, np.float32).reshape(len(rows), len(self.landmarks)))
        return out


def distinct_words(text: str) -> set[str]:
    """The words of a text's sentences. No sentence ends inside a piece, so only spelled-out words need the sentences."""
    low = text.lower()
    found = set(low.split())
    if LONE.search(low):
        found.update(w for s in sentences(text) for w in sentence_words(s))
    return found


def met_words(fresh: list[str], machine: Machine) -> dict[str, float]:
    """Words that any landmark meets, with their pulls."""
    out = {}
    for first in range(0, len(fresh), 50_000):
        part = fresh[first:first + 50_000]
        found = strength([CLEANED.sub("", w) for w in part], machine.landmarks)
        met = np.flatnonzero(found.any(axis=1))
        out.update(zip([part[i] for i in met.tolist()], machine.pulls(found[met]).tolist()))
    return out


def corpus_words(texts: DataFrame, shared, scratch: Scratch) -> DataFrame:
    """Rows (word, pull) of the words of all texts that any landmark meets, each distinct word met by one task.

    Tasks drop their own repeats first, so a word of every text is sent once per task and flush.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            fresh: set[str] = set()
            for text in batch.column(0).to_pylist():
                if text:
                    fresh |= distinct_words(text) - seen
            seen |= fresh
            if len(seen) > REMEMBERED:
                seen.clear()
            for part in in_groups(list(fresh)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["word"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_groups(batch.column(0).to_pylist()):
                met = met_words(part, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.float64())], ["word", "pull"])

    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    words = texts.mapInArrow(listed, "word string").repartition(parts, "word").distinct()
    return scratch.keep(words.mapInArrow(meet, "word string, pull double"), "met_words")


def in_groups(texts: list[str | None], size: int = 4_000_000) -> Iterator[list[str]]:
    group, total = [], 0
    for text in texts:
        group.append(text or "")
        total += len(group[-1])
        if total > size:
            yield group
            group, total = [], 0
    if group:
        yield group


def pick_landmarks(train: DataFrame, count: int = LANDMARKS) -> list[str]:
    """Words and word beginnings that part the classes best, by documents that hold them; none is part of another."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                clean = {CLEANED.sub("", w) for s in sentences(text or "") for w in sentence_words(s)}
                found = {w for w in clean if 3 <= len(w) <= LONGEST}
                found.update(w[:n] for w in clean for n in GRAM_SIZES if len(w) > n)
                counts[toxic].update(found)
        for toxic in (0, 1):
            c = counts[toxic]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["gram", "toxic", "n"])

    sizes = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return []
    table = train.select("text", "toxic").mapInArrow(grams, "gram string, toxic int, n long").groupBy("gram").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")
    )
    t, c = (F.col("t") + 0.5) / (bad + 1), (F.col("c") + 0.5) / (good + 1)
    worth = ((t - c) * F.log(t / c)).alias("worth")
    pooled = (F.col("t") + F.col("c") + 1.0) / (bad + good + 2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / (bad + 1) + 1 / (good + 1)))
    found = table.filter(F.col("t") >= 2).filter(t - c >= CLEAR * spread).select("gram", worth)
    out: list[str] = []
    for gram, _ in found.orderBy(F.desc("worth"), F.desc(F.length("gram")), "gram").limit(40 * count).collect():
        if len(out) < count and not any(gram in o or o in gram for o in out):
            out.append(gram)
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        step = np.linalg.solve(penalty + a.T @ x[active], a.T @ y[active]) - w
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def calibrated(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights for rows of margins and a constant, by Newton steps with a little smoothing of the labels."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([margins, np.ones((len(margins), 1))])
    ridge = 0.1 * np.eye(x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - goal) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train_machine(train: DataFrame, landmarks: int = LANDMARKS) -> Machine:
    """Fits on rows (text, toxic). Of a toxic document the sentence with the greatest strengths is labelled toxic; of a
    clean one its three greatest are labelled clean. The curve from a document's worst sentences to its score is fitted
    on the same documents. The training rows are bounded, and so is what reaches the driver: three sentences of each."""
    marks = pick_landmarks(train, landmarks)
    if not marks:
        return Machine([], np.zeros((0, 0)), np.array([-1.0]), np.array([1.0] + [0.0] * WORST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(marks)
        for batch in batches:
            labels, rows = batch.column(1).to_pylist(), []
            for group in in_groups(batch.column(0).to_pylist()):
                for found in meter.features(group):
                    best = found[np.argsort(-found.astype(float).sum(1), kind="stable")[:WORST]]
                    rows.append(np.vstack([best, np.zeros((WORST - len(best), len(marks)), np.float32)]).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float32()))], ["toxic", "features"])

    table = train.select("text", "toxic").mapInArrow(run, "toxic int, features array<float>").toArrow()
    y = np.where(table.column(0).to_numpy() == 1, 1.0, -1.0)
    x = table.column(1).combine_chunks().flatten().to_numpy().astype(float).reshape(len(y), WORST, len(marks))
    order = np.lexsort([*x.reshape(len(y), -1).T, y])  # rows come in any order
    x, y = x[order], y[order]
    between = strength(marks, marks).astype(float)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    basis = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    one = np.concatenate([x[y > 0][:, 0], x[y < 0].reshape(-1, len(marks))])
    label = np.concatenate([np.ones((y > 0).sum()), -np.ones((y < 0).sum() * WORST)])
    weight = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label < 0).sum()))
    machine = Machine(marks, basis, squared_hinge(one @ basis, label, weight), np.zeros(WORST + 1))
    machine.curve = calibrated(np.array([machine.worst(machine.pulls(f)) for f in x]), y)
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, most: tuple[int, int] = (CLEAN, TOXIC)) -> DataFrame:
    """Rows (text, toxic) of a bounded number of labelled documents of each class outside the held-out quarter."""
    usable = labels.filter(F.col(toxic).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    usable = usable.groupBy(F.col(key).alias("_label_key")).agg(F.max(toxic).cast("int").alias("toxic"))
    order = [F.xxhash64("_label_key"), F.col("_label_key")]
    clean, bad = (usable.filter(F.col("toxic") == t).orderBy(*order).limit(most[t]) for t in (0, 1))
    chosen = clean.union(bad)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    return rows.join(F.broadcast(chosen), rows["_key"] == chosen["_label_key"]).select("text", "toxic")


def held_out(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
             threshold: float = THRESHOLD, landmarks: int = LANDMARKS, sent_bytes: int = 0) -> DataFrame:
    """One row per document: the key, held_out, score and predicted.

    A document scores by its worst sentences; one whose sentences meet no landmark, such as a null or empty text, has
    the score of no match. Only texts are scored. Without toxic labels nothing is predicted toxic.

    A sentence's margin is the sum of its words' pulls. Workers meet each distinct word of their own texts once, so the
    cost follows the texts whatever the vocabulary. With ``sent_bytes``, each distinct word of the corpus meets the
    landmarks once, and pulls are looked up if all met words are within that size; the scores are the same.
    """
    spark = docs.sparkSession
    train = training_rows(docs, labels, key, text, toxic).repartition(24).persist()
    machine = train_machine(train, landmarks)
    train.unpersist()
    shared = spark.sparkContext.broadcast(machine)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    known = None
    if machine.landmarks and sent_bytes > 0:
        scratch = Scratch(spark)
        met = corpus_words(rows.select("_text"), shared, scratch)
        size = met.agg(F.sum(F.octet_length("word") + ENTRY_BYTES)).first()[0] or 0
        if size <= sent_bytes:
            table = met.toArrow()
            known = spark.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist())))
        scratch.drop("met_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        pulls = known.value if known else {}
        none = fitted.score([])
        seen: set[str] = set()
        for batch in batches:
            values = []
            for group in in_groups(batch.column(1).to_pylist()):
                if fitted.landmarks and not known:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                        pulls.clear()
                    fresh = set().union(*[distinct_words(t) for t in group]) - seen
                    pulls.update(met_words(list(fresh), fitted))
                    seen |= fresh
                for t in group:
                    if pulls.keys().isdisjoint(t.lower().split()) and not LONE.search(t.lower()):
                        values.append(none)
                        continue
                    values.append(fitted.score([sum([pulls[w] for w in sentence_words(s) if w in pulls]) for s in sentences(t)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["_key", "score"])

    scores = rows.mapInArrow(run, f"_key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("_key", key)
    return scores.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
