"""Language and quality against plain versions that go text by text, letter by letter and pair by pair."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wavecohort.llm import langid, quality

from .test_operators import documents

MASK = 2**64 - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def letter(code):
    out = []
    for j in range(1, langid.DIM // 64 + 1):
        for byte in mixed((code * 0x9E3779B97F4A7C15 + j) & MASK).to_bytes(8, "little"):
            out += [1 if byte >> b & 1 else -1 for b in range(7, -1, -1)]
    return np.array(out)


def bundle(text, cache):
    seq = [0]
    for ch in (text or "").lower():
        if ch.isalpha():
            seq.append(ord(ch))
        elif seq[-1]:
            seq.append(0)
    seq += [0] if seq[-1] else []
    total = np.zeros(langid.DIM)
    for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
        if b:
            for x in (a, b, c):
                if x not in cache:
                    cache[x] = letter(x)
            total += np.roll(cache[a], 2) * np.roll(cache[b], 1) * cache[c]
    return total


def texts_of(rng):
    kinds = {"en": "the and of that with from have this".split(), "de": "und die der nicht über größe straße".split(), "fr": "les des être où français naïve qui".split()}
    rows = [(" ".join(rng.choices(w, k=rng.randint(1, 30))) + rng.choice(["", ".", "!\n", " 42"]), k) for k, w in kinds.items() for _ in range(12)]
    return rows + [(None, "en"), ("", "de"), ("123 --", None), ("ÀÉ. ß", None), ("the", None), ("same same", "fr"), ("same same", "fr")]


def test_language_equals_the_plain_version(spark):
    rng, cache = random.Random(4), {}
    rows = texts_of(rng)
    docs = spark.createDataFrame([(i, t, k, 1.0, "p") for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    model = langid.learn(docs)
    proto = {}
    for t, k in rows:
        if k is not None and t is not None:
            v = bundle(t, cache)
            proto[k] = proto.get(k, 0) + v / max(np.linalg.norm(v), 1e-12)  # every text weighs the same
    proto = {k: v / np.linalg.norm(v) for k, v in proto.items()}
    assert model.keys() == proto.keys() and all(model[k] == pytest.approx(v, abs=1e-6) for k, v in proto.items())
    for r in langid.predict(docs, model).collect():
        v = bundle(r["text"], cache)
        cos = {k: float(p @ v / np.linalg.norm(v)) for k, p in proto.items()} if v.any() else {}
        best = min(cos, key=lambda k: (-cos[k], k)) if cos else "und"
        assert r["lang_pred"] == best and r["score"] == pytest.approx(min(1, max(0, cos.get(best, 0))), abs=1e-6)


def test_scores_equal_the_sum_over_pairs(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["alpha", "Beta", "gamma.", "x1", "Ü", "\n"], k=rng.randint(0, 25))) for _ in range(40)] + [None, "", "one one one", "one one one"]
    fm = quality.FactorisationMachine(seed=3)
    fm.w = np.random.default_rng(1).normal(0, 0.2, len(fm.w))
    fm.w0 = -0.3
    got = {r["doc_id"]: r["score"] for r in quality.score(documents(spark, texts), fm).collect()}
    for i, t in enumerate(texts):
        ids, x, at = quality.features(pa.array([t], pa.string()), pa.array([None], pa.float64()))
        cells = list(zip(ids.tolist(), x.tolist(), strict=True))
        assert at.tolist() == [0, len(cells)]
        words = Counter((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split())
        held = sorted(v for k, v in cells if k < quality.WORDS)
        norm = math.sqrt(sum(words.values())) or 1
        assert held == pytest.approx(sorted(math.sqrt(c) / norm for c in words.values()))  # a slot a word: none of these share one
        raw = fm.w0 + sum(fm.w[k] * v for k, v in cells)
        raw += sum(float(fm.v[a] @ fm.v[b]) * u * v for (a, u), (b, v) in itertools.combinations(cells, 2))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-5)
