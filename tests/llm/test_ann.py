"""Nearest neighbours: recall against brute force, exact scores, early abandonment, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.llm import ann as A

from ..conftest import DATA


def brute(rows, asked, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i in {i for i, _ in ok if asked(i)}:
        d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for p, q in ok if p == i for j, v in ok if j != i)[:k]
        out[i] = d
    return out


def found(spark, rows, k=10, **args):
    df = spark.createDataFrame([(i, v, 0, "x", 1.0, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, asked int, list string, limit double, part int, id long").repartition(3)
    got = {}
    for r in A.nearest(df, F.col("vec_id") % 20 == 0, k, **args).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_and_exact_scores_of_the_query(spark):
    t = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in t], lambda i: i % 100 == 0)
    got = {}
    for r in A.op13_ann(spark, DATA).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({j for _, j in want[q]} & got[q].keys()) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in t}
    assert all(s == pytest.approx(np.sqrt(((x[q] - x[v]) ** 2).sum()), rel=1e-14) for q, vs in got.items() for v, s in vs.items())


def test_clustered_vectors_are_abandoned_early(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 4, (40, 64))
    x = (centre[rng.integers(0, 40, 4000)] + rng.normal(0, 1, (4000, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(A, "BLOCK", 64)  # hot lists are cut
    got, want = found(spark, rows), brute(rows, lambda i: i % 20 == 0)
    recall = np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want])
    assert recall >= 0.97
    c = A.centres_of(x.astype(float), 63)
    assert A.probes_for(x.astype(float), c, 10, 0.98) < 20  # a part of the lists
    turn = A.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    cols = np.ascontiguousarray((x @ turn.T).T.astype("<f4"))
    limit = want[0][-1][0] ** 2 * (1 + 1e-12)
    part = ((cols[: A.STEP] - (x[0] @ turn.T)[: A.STEP, None]) ** 2).sum(axis=0)
    assert (part > limit * A.STEP / 64 * (1 + A.EPSILON / A.STEP**0.5) ** 2).mean() > 0.5  # after a quarter of the components
    at, dist = A.scan(x[0].astype(float), (x[0] @ turn.T).astype(np.float32), cols, x.astype(float), limit, 10, np.arange(4000) == 0)
    assert sorted(at[np.argsort(dist)[:10]]) == sorted(j for _, j in want[0])


def test_edge_cases(spark):
    assert found(spark, []) == {} and found(spark, [(1, [1.0, 0.0])]) == {}
    assert found(spark, [(20, [1.0, 0.0])]) == {}  # no candidate
    odd = [(20, [1.0, 0.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [float("nan"), 1.0]), (120, [None, 1.0]), (140, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    same = [(i, [0.0, 1.0]) for i in range(300, 201, -1) if i % 20]
    short = [(7, [2.0])]  # a zero at its end
    twice = [(11, [1.0, 0.5]), (11, [1.0, 0.5]), (160, [3.0, 3.0]), (160, [5.0, 5.0])]
    rows = odd + same + short + twice
    got = found(spark, rows, recall=1.0)
    padded = [(i, v + [0.0] if v and len(v) == 1 else v) for i, v in rows]
    want = brute(padded, lambda i: i % 20 == 0)
    assert sorted(got) == [20, 160] and got.keys() == want.keys()
    for q in got:
        assert [j for _, j in got[q]] == [j for _, j in want[q]] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]])


def test_a_vector_that_a_third_repeat(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 50)
    rng = np.random.default_rng(0)
    rows = [(i, [1.0] * 8 if i % 3 == 0 else rng.normal(0, 1, 8).round(3).tolist()) for i in range(900)]
    got, want = found(spark, rows), brute([(i, np.float32(v).tolist()) for i, v in rows], lambda i: i % 20 == 0)
    for q in (0, 60, 300):  # copies of it: the ten smallest ids, none further off
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
    assert np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want]) >= 0.9
