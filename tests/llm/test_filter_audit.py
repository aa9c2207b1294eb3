"""Filter audit: the transducer and the counts against plain loops."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from geoloom.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORDS.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def scan(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return filter_audit.scan(np.frombuffer(b"".join(raw), np.uint8), offsets).tolist()


def test_the_transducer_counts_like_plain_loops():
    rng = random.Random(5)
    for _ in range(200):
        texts = ["".join(rng.choice("ab AÉ日#\t\n🙂\x1c\xa0 b") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        assert scan(texts) == [counts(t) for t in texts]


def test_a_full_table_and_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(filter_audit, "_hashes", lambda raw, s, e, d: np.zeros(len(s), np.uint64))
    texts = ["a b a c ab ba", "a b", "", "x " * 40]
    assert scan(texts) == [counts(t) for t in texts]


def test_a_very_long_text():
    text = " ".join(str(k % 50_000) for k in range(200_000))
    assert scan([text]) == [counts(text)]


def fails(row, rows):
    text = row[1] or ""
    words, distinct, capitals, points, symbols = counts(text)
    copy = row[0] is not None and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows)
    return {f for f, hit in zip("ABCDE", (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols > 0, copy)) if hit}


def plain(rows, labels):
    marks = {}
    for i, q, t in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], q or 0), max(old[1], t or 0))
    docs = [(r[2] or "", fails(r, rows), *marks.get(r[0], (0, 0))) if r[0] is not None else (r[2] or "", fails(r, rows), 0, 0) for r in rows]
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, own in enumerate(order):
                before = set(order[:k])
                here = [d for d in mine if own in d[1] and not d[1] & before]
                out[part, order, k + 1] = (
                    sum(not d[1] & (before | {own}) for d in mine), len(here), sum(own in d[1] and bool(d[1] & before) for d in mine),
                    sum(d[1] == {own} for d in mine), sum(d[2] == 1 for d in here), sum(d[3] == 1 for d in here),
                )
                shapley[part, own] = shapley.get((part, own), 0) + len(here)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_orders_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "DELTA", "#x", "é"]
    texts = [None, "", " ", *(" ".join(rng.choice([*words, str(k)]) for k in range(rng.choice([10, 60, 90]))) for _ in range(25))]
    rows = [(rng.choice([None, k, k, k % 7]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for k in range(80)]
    labels = [(rng.choice([None, k]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for k in range(40)] + [(3, 1, 0), (3, 0, 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, counts string, fails string")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_no_documents_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, source string"), labels).collect() == []
