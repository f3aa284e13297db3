"""The corpus operators against brute force, and on nulls, empty and repeated rows, ties and clashing column names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wavecohort.llm import decontaminate as D
from wavecohort.llm import langid, licenses, line_dedup, mixing, pages, quality, tokens, topk
from wavecohort.llm.common import unit

DATA = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, h long, d long, k string, __x string"


def documents(spark, texts, **more):
    rows = [(i, t, more.get("lang"), more.get("source", "s"), None, 1, 2, "k", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


# --- line dedup -----------------------------------------------------------------------------------------------------------


def matched_lines(rows, t=0.8):
    lines = [(d, i, frozenset(re.sub("[A-Z]", lambda m: m[0].lower(), x).split())) for d, text in rows for i, x in enumerate((text or "").split("\n"))]
    lines = sorted([x for x in lines if x[2]], key=lambda x: x[:2])
    out = set()
    for j, (d, i, s) in enumerate(lines):
        if any(len(s & o) >= t * len(s | o) - 1e-9 for _, _, o in lines[:j]):
            out.add((d, i))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            if rng.random() < 0.6 and line:
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(("  " if rng.random() < 0.3 else " ").join(line).capitalize())
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", " \t "]
    docs = documents(spark, texts)
    got = {(r["d"], r["i"]) for r in line_dedup.later_matches(docs).collect()}
    assert got == matched_lines(list(enumerate(texts)))
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in got)
        assert kept[i] == want
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.annotate_lines(documents(spark, [])).count() == 0


def test_line_dedup_family_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies that differ in common words: most pairs of them are alike, and few are made."""
    rng = random.Random(3)
    common, base = [f"c{i}" for i in range(40)], [f"b{i}" for i in range(30)]
    texts = []
    for _ in range(300):
        line = list(base)
        for at in rng.sample(range(30), rng.randint(1, 2)):
            line[at] = rng.choice(common)
        texts.append(" ".join(line))
    texts += [" ".join(rng.sample(common, 8)) for _ in range(60)]
    made, written = {}, line_dedup.written

    def counted(df, name="step"):
        got = written(df, name)
        made[name] = made.get(name, 0) + got.count()
        return got

    monkeypatch.setattr(line_dedup, "written", counted)
    got = {(r["d"], r["i"]) for r in line_dedup.later_matches(documents(spark, texts)).collect()}
    assert got == matched_lines(list(enumerate(texts)))
    assert len(got) > 200
    assert made["line-pairs"] + made["candidates"] < 8 * len(texts)


def test_line_dedup_meets_pairs_at_their_first_tokens_alone(spark):
    """A pair that can reach the threshold is never lost, and equal lines meet in the tokens that leave enough behind them,
    not in all that are posted."""
    rng = random.Random(5)
    sets = [set(range(0, 50)), set(range(0, 50)), *({x for x in range(30) if rng.random() < 0.9} for _ in range(60)), set(range(100, 110)), set(range(100, 108))]
    rows = []
    for d, s in enumerate(sets):
        n = len(s)
        rows += [(k, d, 0, 0, 0, n << 32 | p) for p, k in enumerate(sorted(s)[: n - math.ceil(n * 0.8 - 1e-9) + 1])]
    posts = spark.createDataFrame(rows, "k long, d long, i int, b long, h long, np long")
    met = Counter((r["d1"], r["d2"]) for r in line_dedup._meet(posts, posts, ["k"], 0.8).collect())
    alike = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert len(alike) > 100 and alike <= set(met)
    assert met[0, 1] == 50 - 45 + 1  # 45 of 50 tokens are needed; 11 are posted


def test_line_dedup_repeats_by_place_and_line_counts(spark):
    """Repeats within a document and across documents, rows that share an id, a null id, and numbers of lines."""
    long = " ".join(f"x{i}" for i in range(20))
    rows = [(3, f"{long}\n\n{long}"), (1, f"{long} y"), (2, "a b\n"), (2, "a b"), (None, long), (4, None), (5, "\n\n"), (6, ""), (7, "A  b\té")]
    got = line_dedup.annotate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_lines"], list(r["removed"])) for r in got) == [
        (0, 1, []), (1, 1, []), (2, 1, []), (2, 2, []), (3, 3, [0, 2]), (4, 0, []), (5, 3, []), (6, 1, []), (7, 1, [])
    ]


def test_line_dedup_splits_lines_once(spark, monkeypatch):
    """Postings and counts of tokens read one file of token hashes, made of lines with a token alone; only the texts of
    candidates are split again. Other white space parts tokens too."""
    texts = ["a b c d e f\n\t\r\n x\ta ", "A\tb c\x0bd e\x0cf\r\n \t\n", "\t\r", "q r q"]
    kept, written = {}, line_dedup.written

    def held(df, name="step"):
        got = written(df, name)
        if name == "line-tokens":
            kept["lines"] = [(r["d"], r["i"], len(set(r["s"]))) for r in got.collect()]
        return got

    monkeypatch.setattr(line_dedup, "written", held)
    got = {(r["d"], r["i"]) for r in line_dedup.later_matches(documents(spark, texts)).collect()}
    assert got == matched_lines(list(enumerate(texts))) == {(1, 0)}
    assert sorted(kept["lines"]) == [(0, 0, 6), (0, 2, 2), (1, 0, 6), (3, 0, 2)]


# --- mixing -----------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    docs = documents(spark, [f"t{i}" for i in range(3000)]).selectExpr("*", "IF(doc_id % 10 = 0, NULL, IF(doc_id % 3 = 0, 'a', 'b')) AS src").drop("source").withColumnRenamed("src", "source")
    weights = {"a": 0.75, "b": 0.25}
    got = mixing.mix(docs, weights=weights).collect()
    n = {"a": 900, "b": 1800}
    for s in ("a", "b"):
        assert abs(sum(r["source"] == s for r in got) - 3000 * weights[s]) < 5 * math.sqrt(3000)
    assert not any(r["source"] is None for r in got)
    one = [r["mix_copy"] for r in got if r["doc_id"] == got[0]["doc_id"]]
    assert sorted(one) == list(range(1, len(one) + 1))
    rate = 3000 * 0.75 / n["a"]
    us = {r["doc_id"]: r["u"] for r in docs.filter("source = 'a'").select("doc_id", unit(mixing.F.lit("count"), mixing.F.col("doc_id"), seed=42).alias("u")).collect()}
    counts = {i: sum(r["doc_id"] == i for r in got) for i in list(us)[:40]}
    for i, c in counts.items():  # the Poisson quantile
        k, p = 0, math.exp(-rate)
        while p <= us[i]:
            k += 1
            p += math.exp(-rate) * rate**k / math.factorial(k)
        assert c == k
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7), weights=weights, max_broadcast_sources=0).collect()), key=repr)
    assert mixing.mix(documents(spark, [])).count() == 0
    keys = [r["mix_key"] for r in mixing.shuffled(mixing.mix(docs)).collect()]
    assert keys == sorted(keys)


# --- decontamination --------------------------------------------------------------------------------------------------------


def brute_hits(text, items, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for i in range(max(len(v) - n + 1, 1) if v else 0):
            g = v[i : i + n]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(item)
    return len(w), len(hit), found, hit, w


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_WINDOWS, 0])
def test_decontamination_matches_brute_force(spark, bound):
    rng = random.Random(4)
    voc = ["uno", "Dos", "tres", "äß", "x1"]
    items = [(i, " ".join(rng.choices(voc, k=k))) for i, k in enumerate([3, 12, 15, 10, 1])] + [(7, None), (8, ""), (9, "...")]
    items.append((10, items[1][1]))
    texts = [" ".join(rng.choices(voc + ["zz"], k=40)) for _ in range(15)] + [f"pre, {items[1][1].upper().replace('Ä', 'ä').replace('SS', 'ß')}! post", "go " + items[2][1] + " " + items[2][1], None, "", "--"]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in D.annotate(docs, bench, max_broadcast_windows=bound).collect()}
    for i, t in enumerate(texts):
        n, h, found, _, _ = brute_hits(t, items)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) == (n, h, len(found), sha, h > 0)
    clean = {r["doc_id"] for r in D.remove_documents(docs, bench, max_broadcast_windows=bound).collect()}
    assert clean == {i for i in got if not got[i]["contaminated"]}
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(docs, bench, max_broadcast_windows=bound).collect()}
    for i, t in enumerate(texts):
        _, h, _, hit, w = brute_hits(t, items)
        if not h:
            assert cut[i] == t
        else:
            assert brute_hits(cut[i], [])[4] == [x for j, x in enumerate(w) if j not in hit]
    none = bench.filter("false")
    assert not any(r["contaminated"] for r in D.annotate(docs, none).collect())


# --- licences -----------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = "\n".join(["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and", 'associated documentation files (the "Software"), to deal in the Software without restriction,', "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."])
    texts = [mit, "prose\nReleased under the MIT License.\nAll rights reserved.", "Some text. Licensed under CC BY-NC 4.0.", "no licence here", None, "", "SPDX-License-Identifier: Apache-2.0"]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert got[0]["licenses"] == "MIT" and got[0]["sentences"] == "mit-grant mit-notice" and got[0]["use"] == "free"
    assert got[1]["licenses"] == "MIT,LicenseRef-all-rights-reserved" and got[1]["use"] == "closed"
    assert got[2]["licenses"] == "CC-BY-NC-4.0" and got[6]["licenses"] == "Apache-2.0"
    assert all(got[i]["n_licenses"] == 0 and got[i]["use"] == "none" for i in (3, 4, 5))
    assert licenses.scan(documents(spark, [])).count() == 0


# --- language ID and quality ------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    got = langid.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in true if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) / len(held) > 0.98
    model = langid.learn(spark.read.parquet(f"{DATA}/documents.parquet"))
    out = {r["doc_id"]: r for r in langid.predict(documents(spark, [None, "", "123 !!", "the and of"]), model).collect()}
    assert [out[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and out[3]["lang_pred"] in model and 0 <= out[3]["score"] <= 1
    assert langid.predict(documents(spark, []), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(documents(spark, ["abc"]), {}).collect()} == {"und"}


def test_language_vectors_are_whole_text(monkeypatch):
    text = "the and of thing " * 300
    whole = next(iter(langid.bundles([text])))
    monkeypatch.setattr(langid, "_CHUNK", 500)
    cut = next(iter(langid.bundles([text])))
    a, b = whole[1], cut[1]
    assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.999


def test_quality(spark):
    got = quality.op3_quality(spark, "/root/testdata/sf0.01").collect()
    true = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["score"], true[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in true]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    fm = quality.FactorisationMachine()
    out = quality.score(documents(spark, [None, "", "x", "word " * 50_000]), fm).collect()
    assert len(out) == 4 and out[0]["score"] == out[1]["score"]
    assert quality.score(documents(spark, []), fm).count() == 0
    ids, x, at = np.array([1, 5, 9]), np.array([0.5, 0.25, 1.0]), np.array([0, 3])
    pairs = sum(fm.v[ids[i]] @ fm.v[ids[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert fm.raw(ids, x, at)[0][0] == pytest.approx(pairs)


# --- token output ---------------------------------------------------------------------------------------------------------------


def test_token_output_is_an_exact_round_trip(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "beta", "Ünï", "\n", "x" * 30], k=rng.randint(0, 90))) for _ in range(60)] + [None, ""]
    docs = documents(spark, texts)
    shards = tokens.training_order(docs, seq_len=32, per_shard=4)
    path = str(tmp_path / "shards")
    tokens.write_shards(shards, path)
    rows = spark.read.parquet(path).orderBy("shard").collect()
    n = sum(r["n_sequences"] for r in rows)
    assert [r["n_sequences"] for r in rows[:-1]] == [4] * (len(rows) - 1) and [r["first_slot"] for r in rows] == [4 * r["shard"] for r in rows]
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["sha256"] and r["stride"] == 64 and len(r["payload"]) == 64 * r["n_sequences"] for r in rows)
    slots = tokens.read_from(spark, path, 0, n, per_shard=4)
    order = tokens.permuted(np.arange(n), n, 2024)
    stream = np.concatenate([slots[s] for s in order]).tolist()  # one block: the documents in the order of their ids
    want = [t for i in range(len(texts)) for t in [*tokens.encode(texts[i] or "", tokens.VOCABULARY), tokens.END_ID]]
    assert stream[: len(want)] == want and set(stream[len(want) :]) <= {tokens.END_ID}
    assert [a.tolist() for a in tokens.read_from(spark, path, 5, 3, per_shard=4)] == [a.tolist() for a in slots[5:8]]
    assert tokens.training_order(documents(spark, []), seq_len=32).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = tokens.permuted(np.arange(n), n, 5)
    assert sorted(f) == list(range(n)) and (tokens.permuted(f, n, 5, forward=False) == np.arange(n)).all()


# --- pages ----------------------------------------------------------------------------------------------------------------------


def test_pages(spark):
    field = pages.model()
    fresh = pages.labelled_pages(60, seed=99)
    assert sum(pages.main_text(h, field) == "\n\n".join(x) for h, x in fresh) >= 55
    html = "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two <b>three<br>four.<p>Five&#33;</article><footer>&copy; x</footer>"
    rows = [(1, html), (2, None), (3, ""), (4, "<<<>"), (4, "<<<>")]
    got = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1]["text"] == "A & B\n\nOne two three four.\n\nFive!" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 4
    assert pages.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_chain_field_is_exact():
    f = pages.ChainField()
    rng = np.random.default_rng(0)
    f.move, f.start, e = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(6, 2))
    every = [tuple(int(b) for b in np.binary_repr(i, 6)) for i in range(64)]
    score = lambda y: f.start[y[0]] + sum(e[i, y[i]] for i in range(6)) + sum(f.move[a, b] for a, b in zip(y, y[1:], strict=False))
    assert tuple(f.decode(e)) == max(every, key=score)
    p = np.exp([score(y) for y in every])
    p /= p.sum()
    assert f.marginals(e)[0][3, 1] == pytest.approx(sum(q for q, y in zip(p, every, strict=True) if y[3] == 1))


# --- top-k search -----------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k):
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in v:
        if q % 10 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q))[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(2)
    same = [0.25] * 6
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(250)] + [(i, same) for i in range(250, 400)]
    rows += [(400, None), (410, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (420, [float("nan")] * 6), (430, [float("inf")] * 6), (440, []), (None, same)]
    df = spark.createDataFrame([(i, e, 0, "x") for i, e in rows], "vec_id long, embedding array<double>, label int, id string")
    got = {tuple(r) for r in topk.top_k(df, topk.F.col("vec_id") % 10 == 0, 10).collect()}
    assert got == brute_topk(rows, 10)
    few = df.filter("vec_id < 4")
    assert {tuple(r) for r in topk.top_k(few, topk.F.col("vec_id") % 10 == 0, 10).collect()} == brute_topk(rows[:4], 10)
    assert topk.top_k(df.filter("false"), topk.F.col("vec_id") % 10 == 0).count() == 0


def test_dual_search_prunes_nothing_it_should_not():
    rng = np.random.default_rng(3)
    data, q = np.floor(rng.normal(size=(700, 4)) * 100), np.floor(rng.normal(size=(40, 4)) * 100)
    row, ids, s = topk.dual_search(q, np.arange(1000, 1040), data, np.arange(700), 5, np.full(40, topk.NONE))
    for i in range(40):
        want = sorted(zip(-(data @ q[i]), range(700), strict=True))[:5]
        assert sorted(zip(-s[row == i], ids[row == i], strict=True)) == want
