"""Places, ranks and quantiles by partition offsets, against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.operators import groupstats as G
from wavecohort.operators import placed as P
from wavecohort.operators import select as S

KEYS = ["a", None, "b"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    hot = [(KEYS[i % 3], 7.0) for i in range(400)]  # one value holds a third of the rows
    return hot + [(KEYS[int(rng.integers(3))], float(v)) for v in rng.integers(0, 50, 600)] + [("a", None), (None, None)]


def test_places_ranks_and_quantiles(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, v double").repartition(7)
        ranked = G.average_ranks(df, ["k"], "v").collect()
        med = {r["k"]: (r["q"], r["m"]) for r in P.quantiles(df, ["k"], "v", {"q": 0.3, "m": 0.5}).collect()}
        d = P.distribution(df, ["k"], "v").collect()
        places = {r["i"]: r["p"] for r in P.row_places(df, ["k"], ["v", "i"], "p").collect()}
        parts = P.ranged(df, ["k"], ["v"]).select("__part").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1 and len(ranked) == len(rows)
    for k in KEYS:
        v = np.sort([x for q, x in rows if q == k and x is not None])
        for r in ranked:
            if r["k"] == k:
                assert r["rank"] == (None if r["v"] is None else (v < r["v"]).sum() + ((v == r["v"]).sum() + 1) / 2)
        assert med[k] == pytest.approx((np.quantile(v, 0.3), np.median(v)))
        own = sorted((r["v"], r["t"], r["before"], r["n"]) for r in d if r["k"] == k)
        assert own == [(x, (v == x).sum(), (v < x).sum(), len(v)) for x in np.unique(v)]
        order = sorted((-1 if x is None else x, i) for i, (q, x) in enumerate(rows) if q == k)
        assert [places[i] for _, i in order] == list(range(1, len(order) + 1))


def test_no_window_over_a_bare_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").withColumn("g", F.when(F.rand(1) < 0.5, "x").otherwise("y"))
    for got in (G.average_ranks(df, ["k"], "v"), G.fdr_bh(df.withColumn("v", F.col("v") / 100), ["k"], "v", order=["g"]), S.stratified_folds(df, "k", "v", 3)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window " in x]
        assert windows and all("__part" in x or "sum(__s" in x for x in windows), windows  # or over the totals of parts


@pytest.mark.parametrize("parts", ["true", "false"])
def test_fdr_of_large_families(spark, parts):
    rng = np.random.default_rng(8)
    rows = [(f, i, None if i % 17 == 0 else float(round(rng.random() ** 3, 3))) for f in ("x", None) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    try:
        got = G.fdr_bh(spark.createDataFrame(rows, "f string, i int, p double").repartition(5), ["f"], order=["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for f in ("x", None):
        own = sorted((p, i) for g, i, p in rows if g == f and p is not None)
        q = [p * len(own) / (r + 1) for r, (p, _) in enumerate(own)]
        want = {i: min(1.0, min(q[r:])) for r, (_, i) in enumerate(own)}
        found = {r["i"]: r["p_fdr"] for r in got if r["f"] == f}
        assert all(found[i] is None for i in range(0, 300, 17)) and len(found) == 300
        assert {i: found[i] for i in want} == pytest.approx(want)
        assert all(r["significant"] == (r["p_fdr"] is not None and r["p_fdr"] <= 0.05) for r in got)


def test_two_groups_take_both_tests_and_share_a_false_discovery_rate(spark):
    rng = np.random.default_rng(1)
    rows = [(m, g, float(v)) for m, lift, f in (("normal", 1.0, rng.normal), ("skewed", 0.3, lambda *a: rng.exponential(1, a[2]) ** 3), ("null", 0.0, rng.normal)) for g, up in (("a", 0.0), ("b", lift)) for v in f(0, 1, 60) + up]
    got = {r["m"]: r for r in G.two_group_compare(spark.createDataFrame(rows, "m string, g string, v double"), ["m"], "g", "v", "a", "b").collect()}
    assert got["normal"]["test"] == "t-test" and got["skewed"]["test"] == "Mann-Whitney"
    p = sorted((r["p"], m) for m, r in got.items())
    assert {m: got[m]["p_fdr"] for m in got} == pytest.approx({m: min(1.0, min(p[j][0] * 3 / (j + 1) for j in range(i, 3))) for i, (_, m) in enumerate(p)})


def test_no_frame_runs_to_the_end_of_a_key(spark):
    """Spark computes such a frame anew for every row: the square of a key's rows."""
    v = [3.0, 1.0, None, None, 2.0, 5.0, None, 0.5, 4.0, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i int, v double")
    got = P.lowest_from_here(df, ["k"], ["i"], "r", F.col("v"), "low", F.col("v").isNotNull())
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r["i"]: (r["r"], r["low"]) for r in got.collect()}
    assert found == {i: (sum(x is not None for x in v[: i + 1]), min((x for x in v[i:] if x is not None), default=None)) for i in range(len(v))}
