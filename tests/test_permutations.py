"""Permutation tests whose subjects are spread over tasks, against brute force on small tables."""

import hashlib
import itertools

import numpy as np
import pytest

from wavecohort.operators import network as N
from wavecohort.operators import permute as P


def networks(spark, n=60, partitions=5):
    rng = np.random.default_rng(4)
    rows = [(s, "ab"[s % 3 == 0], band, f"n{i}", f"n{j}", float(rng.normal(7 + 0.5 * (s % 3 == 0) * (i == 0), 1))) for s in range(n) for band in ("x", "y") for i, j in itertools.combinations(range(5), 2)]
    return rows, spark.createDataFrame(rows, "subject_id long, grp string, band string, ch1 string, ch2 string, weight double").repartition(partitions)


def brute_null(rows, band, thr, n_perms):
    pairs = sorted({(r[3], r[4]) for r in rows})
    ids = sorted({r[0] for r in rows})
    w = {(r[0], r[3], r[4]): r[5] for r in rows if r[2] == band}
    w = np.array([[w[i, *p] for p in pairs] for i in ids])
    n1 = len({r[0] for r in rows if r[1] == "a"})
    out = {}
    for p in range(n_perms):
        order = sorted(range(len(ids)), key=lambda j: hashlib.md5(f"42|{p}|{ids[j]}".encode()).hexdigest())
        a, b = w[order[:n1]], w[order[n1:]]
        t = (a.mean(axis=0) - b.mean(axis=0)) / np.sqrt(a.var(axis=0, ddof=1) / len(a) + b.var(axis=0, ddof=1) / len(b))
        for d, hit in (("positive", t > thr), ("negative", t < -thr)):
            groups = []
            for e in (pairs[i] for i in np.flatnonzero(hit)):
                near = [g for g in groups if any(set(e) & set(f) for f in g)]
                groups = [g for g in groups if g not in near] + [[e, *itertools.chain(*near)]]
            out[p, d] = float(max(map(len, groups), default=0))
    return out


@pytest.mark.parametrize(("width", "at_once"), [(P.WIDTH, 2000), (1e-6, 2000), (P.WIDTH, 25)])  # the second: most cuts are outside the first window; the third: subjects in several groups
def test_null_is_exact(spark, monkeypatch, width, at_once):
    monkeypatch.setattr(P, "WIDTH", width)
    monkeypatch.setattr(N, "SUBJECTS_AT_ONCE", at_once)
    monkeypatch.setattr(N, "PERMS_AT_ONCE", 60)
    rows, df = networks(spark)
    got = N.null_distribution(df, ["band"], [("a", "b")], 0.8, 130)
    found = {(r["band"], r["perm"], r["direction"]): r["max_stat"] for r in got.collect()}
    assert found == {(band, *k): v for band in ("x", "y") for k, v in brute_null(rows, band, 0.8, 130).items()}


def test_memory_of_a_network_of_the_studies_size(monkeypatch):
    """1,711 edges, 34 subjects: what a group of the job makes for each block of permutations, whatever their number."""
    import tracemalloc

    rng = np.random.default_rng(0)
    w = rng.normal(size=(34, 1711))
    tracemalloc.start()
    for perms in P.blocks(N.PERMS_AT_ONCE):
        hi, lo = P.digests(42, perms, [str(i).encode() for i in range(34)])
        one = P.labels(hi, lo, (np.full(500, 2**63, np.uint64), np.zeros(500, np.uint64)), perms)
        s, q = one @ w, one @ w**2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert s.shape == q.shape == (50, 1711) and peak < 20e6


def test_clusters_of_channels_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    chan = [f"c{i}" for i in range(6)]
    near = [("c0", "c1"), ("c1", "c2"), ("c3", "c4"), ("c2", "c5")]
    rows = [(s, "ab"[s % 2], c, float(rng.normal(0.8 * (s % 2) * (c in ("c0", "c1")), 1))) for s in range(30) for c in chan]
    df = spark.createDataFrame(rows, "subject_id long, grp string, channel string, value double")
    stats, members = N.cluster_permutation(df.withColumn("band", N.F.lit("x")), ["band"], [("a", "b")], near, 0.7, 60)
    x = np.array([r[3] for r in rows]).reshape(30, 6)
    ids = list(range(30))

    def clusters(first):
        a, b = x[first], x[[i for i in ids if i not in set(first)]]
        t = (a.mean(axis=0) - b.mean(axis=0)) / np.sqrt(a.var(axis=0, ddof=1) / len(a) + b.var(axis=0, ddof=1) / len(b))
        out = {}
        for d, hit in (("positive", t > 0.7), ("negative", t < -0.7)):
            groups = [{c} for c, h in zip(chan, hit, strict=True) if h]
            for p, q in near:
                joined = [g for g in groups if p in g or q in g]
                if len(joined) == 2:
                    groups = [g for g in groups if g not in joined] + [joined[0] | joined[1]]
            out[d] = {min(g): (len(g), sum(abs(t[chan.index(c)]) for c in g)) for g in groups}
        return out

    null = []
    for p in range(60):
        order = sorted(ids, key=lambda j: hashlib.md5(f"42|{p}|{j}".encode()).hexdigest())  # noqa: B023
        null.append({d: max((m for _, m in v.values()), default=0.0) for d, v in clusters(order[:15]).items()})
    want = {(d, c): (n, pytest.approx(m), pytest.approx((sum(x[d] >= m - 1e-9 for x in null) + 1) / 61)) for d, v in clusters([i for i in ids if i % 2 == 0]).items() for c, (n, m) in v.items()}
    got = {(r["direction"], r["cluster"]): (r["n_channels"], r["mass"], r["p_value"]) for r in stats.collect()}
    assert len(want) > 1 and got == want
    assert members.count() == sum(v[0] for v in want.values())


def test_replicates_can_tell_effects_from_chance(spark, monkeypatch):
    """The queries without SQL, and the whole forms of those with it, run the studies' numbers of replicates."""
    from wavecohort import jobs
    from wavecohort.jobs import model_queries, networks
    from wavecohort.operators import models as M

    asked = []
    null, boot = N.null_distribution, M.bootstrap_effects
    monkeypatch.setattr(N, "null_distribution", lambda e, k, pairs, thr, n, *a, **b: asked.append((n, len(pairs))) or null(e, k, pairs, thr, 2, *a, **b))
    monkeypatch.setattr(M, "bootstrap_effects", lambda df, k, x, m, y, row, reps, *a, **b: asked.append(reps) or boot(df, k, x, m, y, row, 2, *a, **b))
    for name in ("nbs_all_pairs", "nbs_significant_edges", "nbs_summary_whole", "nbs_permutation_test_whole"):
        jobs.QUERIES[name](spark, "/root/testdata/sf0.001")
    for name in ("bootstrap_effects_whole", "percentile_ci_whole", "bootstrap_mediation_whole", "batch_mediation", "component_mediation", "mediation_summary"):
        jobs.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [(3000, 3)] * 4 + [5000] * 6
    assert (networks.PERMS, model_queries.REPS) == (3000, 5000)


def test_bootstrap_matches_brute_force(spark):
    from wavecohort.operators import models as M

    rng = np.random.default_rng(2)
    rows = [(k, i, *map(float, rng.normal(3, 1, 3))) for k in range(60) for i in range(12)]  # more keys than a task holds
    df = spark.createDataFrame(rows, "k int, i int, x double, m double, y double").repartition(3)
    got = {(r["k"], r["rep"]): r["indirect"] for r in M.bootstrap_effects(df, ["k"], "x", "m", "y", "i", 60).collect()}
    for k, rep in ((0, 0), (0, 59), (41, 51), (59, 7)):
        v = np.array([r[2:] for r in rows if r[0] == k])
        u = np.array([int(hashlib.md5(f"42|{rep}|{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(12)])
        c = np.repeat(np.arange(12), [sum(x >= p for p in M._POISSON) for x in u])
        x, m, y = v[c].T
        a = np.cov(x, m)[0, 1] / np.var(x, ddof=1)
        b = np.linalg.lstsq(np.c_[np.ones(len(c)), x, m], y, rcond=None)[0][2]
        assert got[k, rep] == pytest.approx(a * b, abs=1e-9)
    assert len(got) == 60 * 60
