"""Small corpora with every odd case, and plain Python counterparts of the operators."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, doc string, rep string, band string, key string, bucket string, n string, label string, _text string, chunk string, head string"


def sentence(rng, n):
    syllables = ["ka", "lo", "mi", "ru", "se", "to", "va", "é", "ñu", "zy"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    """Copies, near copies, shared passages, runs, ties, blanks, nulls, a very long text and repeated rows."""
    rng = random.Random(7)
    base, passage = sentence(rng, 60), sentence(rng, 30)
    texts = [base, base, base.upper(), base.replace(" ", "\n", 3), " " + base + "\t"]
    for i in range(8):
        near = base.split(" ")
        near[i * 3] = "changed"
        texts.append(" ".join(near))
    for i in range(5):
        texts.append(sentence(rng, 10 + i) + " " + passage + "\n" + sentence(rng, 15))
    texts += [passage + " " + passage, "one two", "one  two", "ONE two", "word", None, "", "   \n\t ", "a " * 60, "x" * 5000]
    texts += [sentence(rng, 6_000), sentence(rng, 4), "it's 12 o'clock <|endoftext|> ²½ _ 漢字 🙂  end", "tab\tand\x1cmore \xa0 space"]
    texts += [sentence(rng, rng.randint(1, 80)) for _ in range(20)]
    out = [(i, t, "en", ["b", "a", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    return out


def frame(spark, data, key_null=False):
    extra = ("x",) * 11
    data = [(*r, *extra) for r in data]
    if key_null:
        data.append((None, "without a key but with quite a few words", "en", "a", 5, *extra))
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    words = WORDS.findall(low(text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def near_groups(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def without_repeats(texts, window=20):
    seen, out = set(), {}
    for key in sorted(texts):
        words = WORDS.findall(texts[key] or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i:i + window])
            if run in seen:
                gone[i:i + window] = [True] * window
            seen.add(run)
        out[key] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out
