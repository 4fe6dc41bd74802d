import random
from itertools import permutations

import pytest

from rowloom.llm import audit
from tests.llm import corpora

SCHEMA = "doc_id long, text string, lang string, part string, _key string, step int, v int"


def simulated(rows, labels):
    """The filters one after another over lists of documents, for every order."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))

    def fails(key, text):
        text = text or ""
        words = corpora.WORDS.findall(text)
        out = set()
        if len(words) < 200:
            out.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            out.add("C")
        if set(text) & set("#$%&*|"):
            out.add("D")
        if text in least and (key is None or key > least[text]):
            out.add("E")
        return out

    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        here = [(key, fails(key, text)) for key, text, lang in rows if (lang or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in d[1] for d in here) - len(gone), sum(d[1] == {f} for d in here),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    table = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {tuple(r[:3]): tuple(r[3:]) for r in table.collect()}


def documents():
    rng = random.Random(3)
    words = [corpora.sentence(rng, 1) for _ in range(400)]
    rows = []
    for i in range(60):
        text = " ".join(rng.sample(words, rng.choice([20, 210, 300])))
        if rng.random() < 0.3:
            text = " ".join([rng.choice(words[:20]) for _ in range(250)])
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.3:
            text += rng.choice("#$%&*|")
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    rows += [(100 + i, rows[i % 3][1], "fr") for i in range(9)]
    rows += [rows[5], (5, rows[7][1], "en"), (None, rows[1][1], "de"), (None, "alone # " * 3, "de"), (None, "alone # " * 3, None)]
    rows += [(200, None, None), (201, "", "en"), (202, " \n", "en"), (203, "word " * 600_000, "xx"), (204, "A", "xx"), (205, "É" * 10, "xx")]
    return rows


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 220, 3)] + [(3, 0, 1), (None, 1, 1), (6, None, 1), (9, 1, None), (999, 1, 1)]


def test_audit_equals_a_simulation(spark):
    rows = documents()
    assert found(spark, rows, LABELS) == simulated(rows, LABELS)


@pytest.mark.parametrize("rows, labels", [([], LABELS), (documents()[:4], []), ([(None, None, None)] * 3, LABELS)])
def test_audit_of_empty_tables(spark, rows, labels):
    assert found(spark, rows, labels) == simulated(rows, labels)


def test_potentials_give_shapley_values(spark):
    rng = random.Random(5)
    counts = [("x", m, rng.randint(0, 50), rng.randint(0, 9), 0) for m in range(8)]
    table = audit.audit_orders(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long"), "PQR")
    got = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in table.collect()}
    for i, name in enumerate("PQR"):
        total = 0
        for order in permutations(range(3)):
            earlier = sum(1 << j for j in order[:order.index(i)])
            total += sum(n for _, m, n, *_ in counts if m >> i & 1 and not m & earlier)
        assert got[name] == total
