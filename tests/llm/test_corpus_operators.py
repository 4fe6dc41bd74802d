import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import bpe, exact, fingerprint, mixing, near, quality, shards, substring, tokens, toxicity
from rowloom.llm.common import Scratch
from rowloom.llm.queries import tokenizer_path
from tests.llm import corpora

ROWS = corpora.rows()
TEXTS = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return corpora.frame(spark, ROWS).persist()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("doc_id < 0")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("head", [0, 5, 100_000])
def test_token_counts_equal_the_library(docs, library, head):
    found = tokens.token_counts(docs, "doc_id", "text", tokenizer_path(), head=head).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in ROWS)
    for r in found:
        text = TEXTS[r["doc_id"]] or ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(text.encode())


def test_bpe_equals_the_library(spark, docs, library):
    path = tokenizer_path()
    for r in bpe.round_trip(docs, "doc_id", "text", path).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == sha(",".join(map(str, ids))) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    back = bpe.decoded(bpe.encoded(docs, "doc_id", "text", path), "doc_id", "ids", path)
    assert all(r["text"] == (TEXTS[r["doc_id"]] or "") for r in back.collect())


def test_segment_trees_agree_with_the_library_on_odd_texts(library):
    codec, rng = bpe.codec(tokenizer_path()), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\t'srlleve1²½_-!?éñ՘\x1c　漢🙂́") for _ in range(rng.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids) == text
    for word in ("", "a", "hello", "x" * 300):
        assert codec.merge(word.encode()) == tuple(library.encode(word, add_special_tokens=False).ids)


def test_near_groups_equal_brute_force(spark, docs):
    wanted = corpora.near_groups(TEXTS)
    found = near.near_groups(docs, "doc_id", "text").collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == wanted[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == wanted[r["doc_id"]][1])
    keyless = near.near_groups(corpora.frame(spark, ROWS[:4], key_null=True), "doc_id", "text").filter("doc_id IS NULL").first()
    assert keyless["component_id"] is None and keyless["kept"]


def test_near_groups_find_chains_inside_a_bucket(spark):
    """Documents that share a passage: many unlinked candidates, and chains whose ends are no link themselves."""
    rng = random.Random(5)
    base = corpora.sentence(rng, 80).split(" ")
    texts = {}
    for i in range(60):
        words = list(base)
        for j in range(rng.randint(0, 14)):
            words[rng.randrange(80)] = f"w{i}x{j}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wanted = corpora.near_groups(texts)
    for small in (1_000_000, 0):
        found = by_id(near.near_groups(df, "doc_id", "text", broadcast_keys=small))
        assert {k: r["component_id"] for k, r in found.items()} == {k: c for k, (_, c) in wanted.items()}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    for n, overlap in ((30, 15), (300, 150), (300, 270)):
        left, right = pool[:n], pool[n - overlap:2 * n - overlap]
        table = near.super_minhash(np.concatenate([left, right]), np.repeat([0, 1], n), 2, 256)
        assert np.isfinite(table).all()
        assert abs((table[0] == table[1]).mean() - overlap / (2 * n - overlap)) < 0.12


def test_components_of_long_paths(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(99)] + [(order[i], order[150]) for i in range(151, 200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found = {r["child"]: r["root"] for r in near.components(df, Scratch(spark), "t").collect()}
    for part in (order[:100], order[150:]):
        assert {x: found.get(x, x) for x in part} == dict.fromkeys(part, min(part))


@pytest.mark.parametrize("window", [3, 20])
def test_repeats_equal_brute_force(docs, window):
    wanted = corpora.without_repeats(TEXTS, window)
    found = substring.without_repeats(docs, window=window)
    assert found.count() == len(ROWS)
    for r in found.collect():
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == wanted[r["doc_id"]]
    for r in substring.without_repeats(docs, window=window, digests=True, broadcast_keys=0).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (*wanted[r["doc_id"]][:2], sha(wanted[r["doc_id"]][2]))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 3, 50):
        words = rng.integers(1, 1 + alphabet, 400).astype(np.uint64)
        starts = np.arange(381)
        anchor, _ = substring.anchors(words, np.zeros(400, int), starts, 20)
        by_window = defaultdict(set)
        for s in starts:
            by_window[words[s:s + 20].tobytes()].add(anchor[s])
        assert all(len(a) == 1 for a in by_window.values())


def test_exact_groups_equal_brute_force(spark, docs):
    groups = defaultdict(list)
    for key, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key))
    for capacity, small in ((4096, 1_000_000), (1, 0)):
        found = exact.duplicates(docs, "doc_id", "text", capacity=capacity, broadcast_keys=small).collect()
        assert len(found) == len(ROWS)
        for r in found:
            norm = re.sub(r"[\x20\x09-\x0D]", "", TEXTS[r["doc_id"]] or "")
            assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (min(groups[norm])[1], len(groups[norm]), sha(norm))
            assert r["kept"] == (r["keep_id"] == r["doc_id"])
    keyless = exact.duplicates(corpora.frame(spark, ROWS[:4], key_null=True), "doc_id", "text").filter("doc_id IS NULL").first()
    assert keyless["keep_id"] is None and keyless["kept"] and keyless["group_size"] == 1


def test_copies_are_removed_by_row_and_not_by_key(spark):
    data = [(1, "a copy"), (None, "a copy"), (None, "alone"), (None, "alone too"), (2, "twice"), (3, "twice"), (3, "only here")]
    data += [(None, "no key"), (None, "no key"), (4, "x y"), (4, "xy"), (4, "other"), (5, "same"), (5, "same"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(data)], "doc_id long, text string, source string").repartition(3)
    found = exact.deduplicated(df)
    assert found.columns == df.columns
    wanted = [(1, "a copy"), (None, "alone"), (None, "alone too"), (2, "twice"), (3, "only here"), (None, "no key"), (4, "x y"), (4, "other"), (5, "same"), (None, "")]
    assert Counter((r["doc_id"], r["text"] or "") for r in found.collect()) == Counter(wanted)


def test_directory_splits_overfull_buckets(spark):
    slots = spark.range(3000).select(F.xxhash64("id").alias("key"))
    buckets = exact.directory(slots, 3000, capacity=10).collect()
    at = {(r["local_depth"], r["bucket"]) for r in buckets}
    sizes = Counter()
    for (key,) in slots.collect():
        own = [(d, b) for d in range(65) for b in [(key % (1 << 64)) >> (64 - d)] if (d, b) in at]
        assert len(own) == 1
        sizes[own[0]] += 1
    assert max(sizes.values()) <= 10 and len({d for d, _ in at}) > 1


def test_fingerprints_and_edited_texts(spark, docs):
    order = sorted(ROWS, key=lambda r: (-r[0], r[1] or ""))
    found = fingerprint.compared(docs).collect()
    assert len(found) == len(ROWS)
    after = {}
    for i, r in enumerate(order):
        after.setdefault(r[0], []).append(order[(i + 1) % len(order)])
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    for r in found:
        text, options = TEXTS[r["doc_id"]] or "", after[r["doc_id"]]
        third = len(text) // 3
        edits = {sha(text[:len(text) - third] + (o[1] or "")[:third]) for o in options}
        assert r["n_chars"] == len(text) and r["edited_sha256"] in edits
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[0] == prints[1] and prints[0] != prints[2]
    own = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    assert fingerprint.compared(own).first()["near_next"] == 1.0


def test_fingerprint_containment_and_ranges(spark):
    rng = random.Random(9)
    long = corpora.sentence(rng, 3000)
    part = " ".join(long.split(" ")[500:900])
    df = spark.createDataFrame([(2, part), (1, long)] + [(i, f"text {i}") for i in range(10, 4010)], "doc_id long, text string")
    found = by_id(fingerprint.compared(df))
    assert len(found) == 4002 and found[2]["in_next"] > 0.9 and found[2]["near_next"] < 0.4
    assert found[11]["edited_sha256"] == sha("text " + "te")  # the next one is in another range or not, alike


def test_shards(docs):
    found = shards.sharded(docs, "doc_id", "text", [1.0] * 24).collect()
    slots = defaultdict(list)
    for r in found:
        data = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights_and_move_few_rows(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    sized = {r["shard"]: r["count"] for r in shards.assign_shards(keys, "k", [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(sized[1] / 20_000 - 0.5) < 0.02
    moved = shards.assign_shards(keys, "k", [1.0] * 3, 1.0).filter("shard != grown_shard")
    assert moved.filter("grown_shard != 3").count() == 0 and abs(moved.count() / 20_000 - 0.25) < 0.02


def test_mixture(docs):
    found = mixing.mixture(docs, "doc_id", "source", mixing.word_count("text")).collect()
    assert len(found) == len(ROWS)
    sizes = {k: len(corpora.WORDS.findall(t or "")) for k, t in TEXTS.items()}
    of_source, total = defaultdict(int), 0
    for key, _, _, source, _ in ROWS:
        of_source[source] += sizes[key]
        total += sizes[key]
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, free = {}, set(order)
    while True:
        left = total - sum(3 * of_source[s] for s in order if s not in free)
        goal = {s: left * weight[s] / sum(weight[f] for f in free) if s in free else 3 * of_source[s] for s in order}
        over = {s for s in free if goal[s] > 3 * of_source[s]}
        if not over:
            break
        free -= over
    source_of = {r[0]: r[3] for r in ROWS}
    taken = defaultdict(int)
    for r in found:
        s = source_of[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == of_source[s]
        assert abs(r["target"] - goal[s]) < 1e-6 * total and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)
    again = mixing.mixture(docs.repartition(7), "doc_id", "source", mixing.word_count("text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_rows_are_copies(docs):
    rows = mixing.mixed(docs, "doc_id", "source", mixing.word_count("text"))
    assert rows.columns == docs.columns
    times = Counter(r["doc_id"] for r in rows.select("doc_id").collect())
    assert times and max(times.values()) <= 6  # the repeated row counts twice


def labelled(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_parts_junk_from_prose(spark):
    rng = random.Random(1)
    texts = [corpora.sentence(rng, 60) if i % 4 else " | ".join(f"%%{rng.randint(0, 99)}" for _ in range(60)) for i in range(240)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    marks = labelled(spark, [(i, int(i % 4 > 0), 0) for i in range(160)])
    found = by_id(quality.resampled(df, marks))
    assert len(found) == 242
    wrong = [i for i in range(240) if found[i]["kept"] != bool(i % 4)]
    assert len(wrong) <= 3
    assert all(r["kept"] for r in quality.resampled(df, marks.filter("doc_id < 0")).collect())
    assert quality.filtered(df, marks).columns == df.columns


def test_quality_judges_rows_and_not_keys(spark):
    rng = random.Random(1)
    good, junk = corpora.sentence, lambda rng, n: " | ".join(f"%%{rng.randint(0, 99)}" for _ in range(n))
    texts = [(good if i % 4 else junk)(rng, 60) for i in range(240)]
    odd = [(k, make(rng, 60)) for k in (None, None, None, 700) for make in (good, junk)]
    df = spark.createDataFrame([*enumerate(texts), *odd], "doc_id long, text string")
    found = quality.filtered(df, labelled(spark, [(i, int(i % 4 > 0), 0) for i in range(160)]))
    kept = {r["text"] for r in found.filter("doc_id IS NULL OR doc_id = 700").collect()}
    assert kept == {t for _, t in odd if "|" not in t}


def test_quality_takes_odd_rows(docs, spark):
    assert quality.resampled(docs, labelled(spark, [(0, 1, 0), (21, 0, 0), (0, None, None)])).count() == len(ROWS)


def test_kth_largest(spark):
    values = [random.Random(1).randint(-10**9, 10**9) for _ in range(500)] + [5] * 20
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 7, 260, 520):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 0) is None


def test_subsequence_kernel_equals_its_definition():
    from itertools import combinations

    def slow(a, b, p=3, decay=toxicity.DECAY):
        return sum(
            decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
            for i in combinations(range(len(a)), p) for j in combinations(range(len(b)), p)
            if all(a[x] == b[y] for x, y in zip(i, j))
        )

    for a, b in (("stupid", "stxupid"), ("abab", "baba"), ("aaa", "aaaa"), ("abc", "xyz")):
        found = toxicity.subsequence_kernel(toxicity.codes([a], 6), toxicity.codes([b], 8))[0]
        assert found == pytest.approx(slow(a, b))


@pytest.mark.parametrize("landmark", ["scum", "dumb", "hell", "idiot", "moron", "loser", "trash", "stupid", "vermin"])
def test_short_landmarks_tolerate_one_inserted_or_missing_character(landmark):
    edited = {landmark[:i] + c + landmark[i:] for i in range(len(landmark) + 1) for c in "xe*1" + landmark[0]}
    edited |= {landmark[:i] + landmark[i + 1:] for i in range(len(landmark))}
    found = toxicity.strength(sorted(edited), [landmark])[:, 0]
    assert not [w for w, v in zip(sorted(edited), found) if v <= 0]
    assert toxicity.strength([landmark, "xyzw"], [landmark])[:, 0].tolist() == pytest.approx([1, 0])


def best_window(word, landmark):
    """The strength over every window of a word that starts at one of the landmark's first two letters, by the kernel alone."""
    width, mark = len(landmark) + toxicity.SLACK, toxicity.codes([landmark], len(landmark))
    windows = toxicity.codes([word[i:i + width] for i in range(len(word)) if word[i] in landmark[:2]] or [""], width)
    own = toxicity.subsequence_kernel(windows, windows)
    value = toxicity.subsequence_kernel(mark, windows) / (toxicity.subsequence_kernel(mark, mark) * (own + 1e-300)) ** 0.5
    return max([v ** toxicity.POWER for v in value if v >= toxicity.MEETS], default=0.0)


def test_strength_equals_the_best_of_all_windows():
    rng = random.Random(8)
    marks = ["scum", "idiot", "moron", "stupid", "glorfing", "abcdefghijklmnopqrst"]
    for landmark in marks:
        words = [landmark]
        for i in range(len(landmark)):
            words += [landmark[:i] + "x" + landmark[i:], landmark[:i] + landmark[i + 1:]]
        words += ["".join(rng.choices("bvwxyz", k=n)) + w + "".join(rng.choices("bvwxyz", k=m)) for w in words[:9] for n, m in ((0, 3), (4, 0), (9, 30), (27, 9), (31, 70), (300, 1))]
        found = toxicity.strength(words, marks)[:, marks.index(landmark)]
        assert found.tolist() == pytest.approx([best_window(w, landmark) for w in words], abs=1e-5)
    noise = ["".join(rng.choices("abcdeimnorstu", k=rng.randint(1, 90))) for _ in range(200)]
    found = toxicity.strength(noise, marks)
    assert all(found[i, k] <= best_window(w, m) + 1e-5 for i, w in enumerate(noise) for k, m in enumerate(marks))


def test_distinct_words_are_those_of_the_sentences():
    texts = [r[1] or "" for r in ROWS] + ["ΑΣ. ΣΑΣ\nΟΔΟΣ ", "i d i o t. I am\x0bhere\u2003s-n-a-b", "a b c. D e. f"]
    for text in texts:
        assert toxicity.distinct_words(text) == {w for s in toxicity.sentences(text) for w in toxicity.sentence_words(s)}


@pytest.mark.parametrize("mark", ["-", "*", "_", "."])
def test_spelled_out_words_are_joined_whatever_marks_surround_the_letters(mark):
    meter = toxicity.Meter(["idiot"])
    spelled = [" ".join(f"{a}{c}{b}" for c in "idiot") for a in ("", mark) for b in ("", mark)]
    spelled += [f"i{mark}d i{mark}o{mark}t", "I D I O T"]
    spelled += [f"i{mark} d {mark}i o {mark}t{mark}"] if mark != "." else []  # a sentence may end at a dot that only some letters have
    for text in [*spelled, *[f"you {s} people" for s in spelled]]:
        assert "idiot" in toxicity.sentence_words(text), text
        assert meter.features([text])[0].max(initial=0) >= 0.999, text
    for text in ("no a b", "as i do it", ""):
        assert toxicity.sentence_words(text) == text.split()


@pytest.mark.parametrize("text", ["you i d i o t. I am here", "you i d i o t\na fool", "he said i-d i-o-t! A b c. D e"])
def test_strengths_do_not_depend_on_other_texts(text):
    alone = toxicity.Meter(["idiot"]).features([text])[0]
    assert len(alone) >= 1 and alone.max() >= 0.999
    others = ["idiot i d i o t", "i d i o t. i", "", "nothing"]
    meter = toxicity.Meter(["idiot"])
    beside = meter.features([*others, text, *others])[len(others)]
    again = meter.features([text])[0]
    assert (beside == alone).all() and (again == alone).all()


def test_toxicity_tolerates_gaps_and_learns(spark):
    rng = random.Random(2)
    insults = ["glorfing", "snaburk", "twizzled"]
    texts = []
    for i in range(200):
        words = corpora.sentence(rng, 40).split(" ")
        if i % 5 == 0:
            for w in rng.sample(insults, 2):
                words.insert(rng.randrange(40), w)
        texts.append(" ".join(words[:20]) + ". " + " ".join(words[20:]))
    odd_ones = [(500, "you glxorfing snaburkx twizzzled one"), (501, "s n a b u r k and t-w-i-z-z-l-e-d"), (502, "twi.zzl.ed twizz_led"), (503, None), (504, ""), (505, "la mi to " * 9000)]
    df = spark.createDataFrame(list(enumerate(texts)) + odd_ones, "doc_id long, text string")
    marks = labelled(spark, [(i, 1, int(i % 5 == 0)) for i in range(200)])
    found = by_id(toxicity.toxicity(df, marks))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(200) if found[i]["held_out"]] == held
    assert all(found[i]["predicted"] == int(i % 5 == 0) for i in held)
    assert [found[i]["predicted"] for i in range(500, 506)] == [1, 1, 1, 0, 0, 0]
    again = by_id(toxicity.toxicity(df.repartition(7), marks, sent_bytes=0))  # workers meet the words of their own texts
    assert again == found
    machine = toxicity.train_machine(toxicity.training_rows(df, marks, "doc_id", "text", "toxic"))
    for i, text in list(enumerate(texts))[:60] + odd_ones:
        rows = toxicity.Meter(machine.landmarks).features([text or ""])[0]
        margins = sorted([*(rows @ machine.basis @ machine.weights[:-1]).tolist(), 0, 0, 0])[::-1][:toxicity.WORST]
        curve = sum((m + machine.weights[-1]) * c for m, c in zip(margins, machine.curve)) + machine.curve[-1]
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(-curve)), abs=1e-6)
    blind = toxicity.toxicity(df, marks.filter("toxic = 0")).collect()
    assert all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in blind)


def test_empty_tables(nothing, spark):
    marks = labelled(spark, [(0, 1, 0)])
    path = tokenizer_path()
    for df in (
        tokens.token_counts(nothing, "doc_id", "text", path), bpe.round_trip(nothing, "doc_id", "text", path),
        near.near_groups(nothing, "doc_id", "text"), substring.without_repeats(nothing), substring.without_repeats(nothing, digests=True),
        exact.duplicates(nothing, "doc_id", "text"), fingerprint.compared(nothing), shards.sharded(nothing, "doc_id", "text", [1.0]),
        mixing.mixture(nothing, "doc_id", "source", mixing.word_count("text")), quality.resampled(nothing, marks),
        toxicity.toxicity(nothing, marks),
    ):
        assert df.count() == 0


def test_null_keys_do_not_fail(spark):
    df = corpora.frame(spark, ROWS[:6], key_null=True)
    marks, path = labelled(spark, [(0, 1, 0), (1, 1, 1), (None, 0, 1)]), tokenizer_path()
    for out in (
        tokens.token_counts(df, "doc_id", "text", path), bpe.round_trip(df, "doc_id", "text", path), substring.without_repeats(df),
        fingerprint.compared(df), shards.sharded(df, "doc_id", "text", [1.0, 1.0]),
        mixing.mixture(df, "doc_id", "source", mixing.word_count("text")), quality.resampled(df, marks), toxicity.toxicity(df, marks),
    ):
        assert out.count() == 7
