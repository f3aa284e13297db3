"""Ranked search against a brute-force version in plain Python; edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from wavecohort.llm import search as S
from wavecohort.llm import words as W

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, terms string, query string, score int, n int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k=50):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in tf]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in asked.items():
        found = []
        for (doc, c), length in zip(tf, lengths, strict=True):
            m = 100 - 50 + (50 * length * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0 and doc is not None:
                found.append((-s, doc))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def searched(spark, docs, items, k=50):
    d = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in docs], DOCS).repartition(4)
    index, n = S.build_index(d)
    got = S.search(index, n, spark.createDataFrame(items, "item_id string, text string"), k)
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect())


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Straße", "naïve", "日本語", "A1"]
    p = 1 / np.arange(1, len(vocab) + 1)
    return [(i, " ".join(rng.choice(vocab, int(rng.integers(1, 40)), p=p / p.sum()))) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "POSTINGS", 150)  # many shards
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)  # several blocks of queries
    docs = corpus(300, 1)
    items = [("a", "w1, W2; w50 w50"), ("b", "Straße-naïve w63"), ("c", "unknown"), ("d", "w0"), ("e", "日本語 a1"), ("f", " ".join(f"w{i}" for i in range(60))), ("g", None), ("h", "")]
    want = brute(docs, items, 7)
    assert want and searched(spark, docs, items, 7) == want
    assert searched(spark, docs, items, 1000) == brute(docs, items, 1000)  # all, if fewer


def test_ties_repeats_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 64)
    same = [(i, "tie word") for i in range(200, 80, -1)]
    docs = [*same, (5, None), (6, ""), (7, "?!"), (None, "tie alone"), (9, "x" * 5000 + " tie"), (10, "long " * 30000 + "tie"), (11, "copy tie"), (11, "copy tie"), *corpus(60, 2)]
    items = [("t", "TIE"), ("t", "w1"), (None, "tie"), ("x", "x" * 5000), ("u", "alone copy")]
    want = brute(docs, items)
    assert sum(r[0] == "t" for r in want) == 50 and any(r[2] == 10 for r in brute(docs, [("l", "long")]))
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, [("l", "long")]) == brute(docs, [("l", "long")])


def test_empty_tables(spark):
    assert searched(spark, [], [("a", "x")]) == []
    assert searched(spark, [(1, "x y"), (2, None)], []) == []
    assert searched(spark, [(1, None), (2, "..")], [("a", "x")]) == []


def test_selection_keeps_ties():
    s, ids = np.array([5, 9, 5, 0, 5, 7]), np.array([8, 1, 3, 2, 4, 6])
    assert [x.tolist() for x in S.best(s, ids, 4)] == [[9, 7, 5, 5], [1, 6, 3, 4]]


def test_words_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    texts = ["one two  three", None, "", "x" * 300 + " y", "tail", "Ü b.c;d", " "] * 3
    whole = W.words(pa.array(texts), S.SEPARATORS, S.SEPARATORS)
    for size in (1, 3, 17, 64):
        monkeypatch.setattr(W, "CHUNK", size)
        part = W.words(pa.array(texts), S.SEPARATORS, S.SEPARATORS)
        for c in ("hashes", "rows", "begins", "ends"):
            assert (getattr(part, c) == getattr(whole, c)).all()
        same = lambda w: (np.diff(w.piece) > 0).tolist()
        assert same(part) == same(whole)
    assert whole.texts(np.arange(3)).to_pylist() == ["one", "two", "three"]
    assert [b - a for a, b in zip(whole.rows, whole.rows[1:], strict=False)][:7] == [3, 0, 0, 2, 1, 4, 0]


@pytest.mark.parametrize("count", [1, 3])
def test_slices_hold_every_row(count):
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["t"])
    got = [x for s in W.slices([batch] * count, 0, 20) for x in s.column(0).to_pylist()]
    assert got == batch.column(0).to_pylist() * count
