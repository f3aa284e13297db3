"""Phrase collocations against a brute-force version in plain Python; edge cases."""

import re
from collections import Counter

import numpy as np
import pytest

from wavecohort.llm import collocations as C
from wavecohort.llm import words as W

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "lang string, text string, key string, f int, h long, n long, w string, phrase string"


def brute(docs, max_n=4, min_count=30, cover=80, top=2000):
    out = []
    counts = {}
    for lang, text in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            own.update(tuple(ws[i : i + k]) for k in range(1, max_n + 1) for i in range(len(ws) - k + 1))
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        dropped = set()
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    sub = p[i : i + k]
                    if sub in held and 100 * a >= cover * held[sub]:
                        dropped.add(sub)
        rows = []
        for p, a in held.items():
            if p not in dropped:
                score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(spark, docs, **args):
    df = spark.createDataFrame([(*d, "a", 1, 2, 3, "b", "c") for d in docs], DOCS).repartition(4)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in C.collocations(df, **args).collect())


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        p = 1 / np.arange(1, 13)
        ws = [f"W{x}" for x in rng.choice(12, int(rng.integers(0, 30)), p=p / p.sum())]
        if i % 3 == 0:
            ws[3:3] = ["new", "york", "stock", "exchange"][: int(rng.integers(2, 5))]
        out.append((["en", "de", None][i % 7 % 3], "".join(w + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "; "], p=[0.7, 0.08, 0.05, 0.08, 0.05, 0.02, 0.02])) for w in ws)))
    return out


@pytest.mark.parametrize("each", [2, 50])  # many buckets: more words are hot, and prefixes lie in several
def test_equals_brute_force(spark, monkeypatch, each):
    monkeypatch.setattr(C, "EACH", each)
    monkeypatch.setattr(C, "SLICE", 500)
    monkeypatch.setattr(C, "HELD", 100)
    monkeypatch.setattr(C, "WORDS_SLICE", 700)
    docs = corpus(400, 5)
    for args in ({"min_count": 5}, {"min_count": 3, "max_n": 5, "top": 15}, {"min_count": 4, "max_n": 2}, {}):
        want = brute(docs, **args)
        assert mined(spark, docs, **args) == want
        assert len(want) > 5


def test_hashes_that_collide_are_made_anew(spark, monkeypatch):
    import pyarrow as pa
    import pyarrow.compute as pc

    real = C._count_words

    def poor(seed):
        count = real(seed)

        def run(batches):
            for b in count(batches):
                yield b if seed else b.set_column(1, "h", pc.bit_wise_and(b.column(1), pa.scalar(3, pa.int64())))

        return run

    monkeypatch.setattr(C, "_count_words", poor)
    base = spark.createDataFrame([("en", "a b c d e f g h")] * 3, "lang string, t string")
    vocabulary, seed = C._vocabulary(base, 1)
    assert seed != 0 and {r["w"]: r["n"] for r in vocabulary.filter("h IS NOT NULL").collect()} == dict.fromkeys("abcdefgh", 3)
    docs = corpus(100, 6)
    assert mined(spark, docs, min_count=4) == brute(docs, min_count=4)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 128)
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, ""), ("de", " . , ")]) == []
    long = " ".join(f"x{i % 40} same pair" for i in range(20000))
    docs = [("en", long), (None, "null lang " * 35), ("", "empty name! " * 31), *[("fr", "tie one. tie two. tie three")] * 40, ("en", "é" * 3000 + " " + "y" * 3000), ("en", None)]
    want = brute(docs)
    assert {r[0] for r in want} == {"en", "und", "", "fr"} and sum(r[0] == "fr" for r in want) == 3
    assert mined(spark, docs) == want


def test_arithmetic_past_64_bits(spark):
    from pyspark.sql import functions as F

    score = "CAST((CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(8,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)"
    rows = [(10**15 + 7, 10**15 + 9, 3 * 10**15 + 1), (9 * 10**17, 9 * 10**17, 9 * 10**17), (30, 31, 77)]
    got = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", F.expr(score)).collect()
    assert [r["s"] for r in got] == [2000000 * a // (x + r) for a, x, r in rows]


def test_prefixes_are_counted_in_one_run():
    rows = np.array([[3, 1, 2], [3, 1, 0], [2, 2, 2], [2, 2, 1], [2, 0, 0], [1, 3, 3]])
    counts = np.array([4, 1, 2, 5, 7, 1])
    got = {(k, *rows[i, :k].tolist()): int(c) for k, at, total in C.count_prefixes(rows, counts) for i, c in zip(at, total, strict=True)}
    want = Counter()
    for r, c in zip(rows.tolist(), counts.tolist(), strict=True):
        for k in range(1, 4):
            if r[k - 1]:
                want[(k, *r[:k])] += c
    assert got == dict(want)
