"""Near-dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from wavecohort.llm import neardup as N
from wavecohort.llm.common import shingles_of, words_of


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


def components(sets, t=75):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(words, rate, rng, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < rate else w for w in words]


def test_graded_copies_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + [f"v{i}" for i in range(400)]
    texts = []
    for size in (150, 40, 9):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += [" ".join(edited(base, rng.random() * 0.2, rng, vocabulary)) for _ in range(110)] + [" ".join(base)] * 3
    texts += ["", "   ", None, "one", "One", "two three", "a b c d", "a b c d e"] + [" ".join(rng.choices(vocabulary, k=60)) for _ in range(20)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    got = {r["doc_id"]: r for r in N.near_duplicates(docs).collect()}
    sets = sets_of(texts)
    want = components(sets)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in got)
    kept = {r["doc_id"] for r in N.keep_one(docs).collect()}
    assert kept == {i for i in range(len(texts)) if want[i] == i}


def test_edge_cases(spark):
    schema = "doc_id long, text string, id string, k long"
    assert N.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", "", 1), (3, "a b c d e f", None, 2), (3, "a b c d e f", None, 2), (4, "A b  c d e f", "z", None), (5, None, "", None)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (5, 0, 5, True)]


def test_an_id_with_several_texts_loses_no_link(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    near = lambda w: [*w[:-2], word(), word()]
    rows = [(1, a), (1, b), (2, b), (3, near(b)), (5, c), (5, near(a)), (4, near(c)), (7, c), (7, c), (9, b), (1, c)]
    rows = [(i, " ".join(w)) for i, w in rows] + [(8, "x y"), (8, None), (6, "x y")]
    ids, texts = zip(*rows, strict=True)
    comp = components(sets_of(texts))
    least = {k: min(i for i, c in zip(ids, comp, strict=True) if c == k) for k in comp}
    want = sorted((i, len(s), least[k] if s else i) for i, s, k in zip(ids, sets_of(texts), comp, strict=True))
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = N.near_duplicates(df).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(100_000)]
    other = list(words)
    for i in range(0, 100_000, 100):
        other[i] = "zz"
    docs = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(other)), (3, " ".join(words[:40_000])), (4, "w1")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in N.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert got[2]["n_shingles"] == len(sets_of([" ".join(words)])[0])


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        es = []
        for _ in range(20):
            both = rng.integers(0, 2**63, 800, dtype=np.uint64)
            k = int(800 * share)
            other = np.concatenate([both[:k], rng.integers(0, 2**63, 800 - k, dtype=np.uint64)])
            es.append(N.estimate(N.registers_of(both)[None], N.registers_of(other)[None])[0])
        assert abs(np.mean(es) - share / (2 - share)) < 0.03


def test_small_sets_fill_all_registers():
    for text in ("x", "x y", "a b c d e f"):
        w, at = words_of(pa.array([text]))
        r = N.registers_of(shingles_of(w[at[0] : at[1]]))
        assert len(r) == N.REGISTERS and len(N.band_keys(r)) == N.BANDS
