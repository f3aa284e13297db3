"""Queries that gave a part of their bands, pairs, thresholds or baseline."""

import itertools

import numpy as np
import pytest

from wavecohort import jobs
from wavecohort.jobs import model_queries, networks
from wavecohort.operators import network as N

from .conftest import DATA


def component_sizes(edges):
    """Numbers of edges of the components."""
    groups = []
    for e in edges:
        near = [g for g in groups if any(set(e) & set(f) for f in g)]
        groups = [g for g in groups if g not in near] + [[e, *itertools.chain(*near)]]
    return [len(g) for g in groups]


def clustering_and_length(w):
    """Of a complete weighted graph's matrix."""
    n, c = len(w), np.cbrt(w / w.max())
    nodes = [2 * sum(c[i, j] * c[j, k] * c[i, k] for j, k in itertools.combinations([x for x in range(n) if x != i], 2)) / ((n - 1) * (n - 2)) for i in range(n)]
    d = w.copy()
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return np.mean(nodes), d.sum() / (n * (n - 1))


def test_every_threshold(spark):
    got = jobs.QUERIES["multi_threshold_explore_whole"](spark, DATA).collect()
    t = networks._t(spark, DATA).collect()
    want = {}
    for x in networks.THRESHOLDS:
        for r in t:
            if abs(r["t"]) > x:
                want.setdefault((r["freq_band"], r["g1"], r["g2"], x, "positive" if r["t"] > 0 else "negative"), []).append((r["ch1"], r["ch2"]))
    assert {k[3] for k in want} >= {1.0, 1.5, 2.0}
    found = {(r["freq_band"], r["g1"], r["g2"], r["threshold"], r["direction"]): (r["n_supra"], r["n_components"], r["largest"]) for r in got}
    brute = {}
    for k, e in want.items():
        sizes = component_sizes(e)
        brute[k] = (len(e), len(sizes), max(sizes))
    empty = {k: v for k, v in found.items() if k not in brute}
    assert {k: v for k, v in found.items() if k in brute} == brute
    assert len(found) == 2 * 3 * len(networks.THRESHOLDS) * 2 and empty and set(empty.values()) == {(0, 0, 0)}


def test_every_band_and_pair(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "REPS", 20)
    got = jobs.QUERIES["component_mediation"](spark, DATA).collect()
    comp = {tuple(r) for r in networks._components(spark, DATA).select(*networks.BY, "component").distinct().collect()}
    assert {(r["freq_band"], r["g1"], r["g2"], r["direction"], r["component"]) for r in got} == comp and len(got) == 2 * len(comp)
    per = {r["grp"]: r["n"] for r in networks.edges(spark, DATA).filter("freq_band = 'b0' AND ch1 = 'n0' AND ch2 = 'n1'").groupBy("grp").agg({"*": "count"}).toDF("grp", "n").collect()}
    assert all(r["n"] == per[r["g1"]] + per[r["g2"]] for r in got)


def test_sigma_is_over_random_graphs(spark):
    rows = jobs.QUERIES["small_world_sigma_whole"](spark, DATA).collect()
    graphs = {}
    for r in N.random_edges(spark, 50, 8, 28).collect():
        w = graphs.setdefault(r["graph"], np.zeros((8, 8)))
        i, j = int(r["ch1"][1:]), int(r["ch2"][1:])
        w[i, j] = w[j, i] = r["weight"]
    c, length = np.mean([clustering_and_length(w) for w in graphs.values()], axis=0)
    assert len(graphs) == 50 and len(rows) == 1000
    for r in rows[:50]:
        assert r["sigma"] == pytest.approx((r["clustering"] / c) / (r["path_length"] / length), rel=1e-3)


def test_disconnected_graphs_are_skipped_or_redrawn(spark):
    drawn = {}
    for r in N.random_edges(spark, 30, 6, 6).collect():
        drawn.setdefault(r["graph"], []).append((r["ch1"], r["ch2"]))
    good = {g for g, e in drawn.items() if len(component_sizes(e)) == 1 and len({x for p in e for x in p}) == 6}
    assert 0 < len(good) < 30
    kept = N.random_graphs(spark, 30, 6, 6).select("graph").distinct().collect()
    assert {r["graph"] for r in kept} == good
    again = N.random_graphs(spark, 30, 6, 6, redraw=True)
    assert again.select("graph").distinct().count() == 30 and again.count() == 180
    with pytest.raises(ValueError, match="cannot connect"):
        N.random_graphs(spark, 3, 6, 4)
