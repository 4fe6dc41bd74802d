import hashlib
import random
import re

import numpy as np
import pytest

from rowloom.llm import pii, piispans
from tests.llm import corpora

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
SCHEMA = "doc_id long, text string, spans string, kind int, votes int, n_email string"


def sound(kind, value):
    digits = re.sub("[^0-9]", "", value)
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return {
        "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
        "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15,
    }[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if sound(k, m[0])]


def card(rng, n=16):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(digits + c for c in "0123456789" if piispans.luhn(digits + c))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)


def planted():
    """Documents with base spans, with spans that only the method can add (``wanted``), and with harmless numbers."""
    rng = random.Random(6)
    rows, wanted, harmless = [], {}, set()
    phone = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    for i in range(400):
        before, after = corpora.sentence(rng, 12), corpora.sentence(rng, 8)
        base = rng.choice([f"mail {rng.choice(['ana', 'bo'])}{i}@mail.example.com", f"call +1 {phone()}", f"host 93.{i % 250}.7.{i % 99}",
                           f"card {card(rng)}", f"visa {card(rng)[:4]}-1111", f"nothing {i % 10}", f"🙂 tel +49 30 {rng.randint(10**6, 10**7 - 1)}"])
        extra = ""
        if i % 5 == 0:
            extra = rng.choice([f"write to kim{i} (at) example (dot) org", f"phone {phone()}", "".join([a := card(rng), " ", card(rng)])])
            wanted[i] = len(before) + 2 + len(base) + max(extra.find("kim"), extra.find("("), 0)
            if "kim" in extra:
                wanted[i] = len(before) + 2 + len(base) + extra.find("kim")
        elif i % 5 == 1:
            extra = rng.choice([f"version 1.{i}.300.4", f"order {10**15 + 7 * i}", f"isbn 978-3-16-148410-{i % 10}", "on 2024-01-15 it was", "look at example.com now"])
            if extra.startswith(("isbn", "on", "look")):
                harmless.add(i)
        rows.append((i, f"{before} {base} {extra} {after}"))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), rows[3], (3, "other text, mail a@b.cd"), (1002, "1.2.3.4 " * 3000 + "x " * 1_500_000), (1003, "0" * 3_000)]
    return rows, wanted, harmless


@pytest.fixture(scope="module")
def found(spark):
    rows, wanted, harmless = planted()
    return rows, wanted, harmless, pii.personal_data(frame(spark, rows)).collect()


def test_base_spans_equal_the_patterns(found):
    rows, _, _, table = found
    lists = {(k, hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base_spans(t)).encode()).hexdigest()): t for k, t in rows}
    assert len(table) == len(rows)
    for r in table:
        text = lists[r["doc_id"], r["base_sha256"]]
        base = base_spans(text)
        assert [r[f"n_{k}"] for k, _ in BASE] == [sum(s[0] == k for s in base) for k, _ in BASE]
        spans = [s for s in r["spans"].split(",") if s]
        assert {f"{a}:{b}:{c}" for a, b, c in base} <= set(spans) and len(spans) == len(base) + r["n_added"]
        parts = [(piispans.KINDS.index(k), int(s), int(e)) for k, s, e in (s.split(":") for s in spans)]
        assert parts == sorted(parts)


def test_added_spans_are_planted_ones(found):
    _, wanted, harmless, table = found
    rows = {r["doc_id"]: r for r in table if r["doc_id"] is not None and r["doc_id"] < 1000}
    caught = [i for i, start in wanted.items() if f":{start}:" in rows[i]["spans"]]
    assert len(caught) >= 0.9 * len(wanted)
    assert not [i for i in harmless if rows[i]["n_added"]]


def test_reruns_and_partitions_agree(spark, found):
    rows, _, _, table = found
    again = pii.personal_data(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, table))


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None)], [(1, "no data here")], [(1, "a@b.cd")]])
def test_small_tables(spark, rows):
    table = pii.personal_data(frame(spark, rows))
    assert [tuple(r)[1:5] for r in table.collect()] == [(int("@" in (t or "")), 0, 0, 0) for _, t in rows]


def test_scans_equal_the_patterns():
    rng = random.Random(1)
    alphabets = ["0123456789", "0123 .-", "a@b.c-", "+1()", "4111 1111-"]
    for n in range(4000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        if n % 3 == 0:
            text = rng.choice(["4111111111111111", "a.b@c.de", "1.2.3.4", "+1 (212) 555-1234", "4111-1111 1111 1111"]) + text
        assert [(piispans.KINDS[k], s, e) for k, s, e, ok in piispans.base_matches(text) if ok] == base_spans(text)


def test_estimation_equals_it_over_rows_and_recovers_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.65, 0.6, 0.85])
    votes = np.where(rng.random((6000, 7)) < right, np.where(truth, 2, 1)[:, None], np.where(truth, 1, 2)[:, None])
    votes[rng.random((6000, 7)) < 0.3] = 0
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    belief, tables, share = pii.estimated(counts, patterns)
    alone, _, _ = pii.estimated(np.ones(6000), votes)
    assert np.allclose(belief[place.ravel()], alone) and abs(share - truth.mean()) < 0.03
    assert np.allclose(tables[1, :, 2] / (tables[1, :, 1] + tables[1, :, 2]), right, atol=0.05)
    odds = np.where(votes == 0, 0, np.where(votes == 2, 1, -1)) @ np.log(right / (1 - right)) + np.log(0.3 / 0.7)
    assert np.mean((alone >= 0.5) == truth) >= np.mean((odds >= 0) == truth) - 0.005
