"""Group tests and p-values against published and closed-form values."""

import math

import numpy as np
import pytest

from wavecohort.functions import special as S
from wavecohort.operators import groupstats as G
from wavecohort.operators import models as M

# Subject means of a band (x 1e12) in three groups, used as a small fixture.
A, B, C = [1.2, 2.3, 3.1, 2.2], [2.9, 3.8, 4.4, 3.3, 4.1], [1.0, 1.9, 2.2]


def frame(spark, groups=(A, B, C)):
    rows = [("m", "abc"[i], float(v)) for i, g in enumerate(groups) for v in g] + [("m", "a", None), ("m", None, 3.0), ("m", "b", float("nan"))]
    return spark.createDataFrame(rows, "metric string, grp string, value double")


def test_tails():
    assert S.chi2_sf(2.8066, 2) == pytest.approx(math.exp(-1.4033), abs=1e-12)
    assert S.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert S.f_sf(4.0, 2, 20) == pytest.approx((1 + 2 * 4 / 20) ** -10, abs=1e-9)
    assert S.normal_ppf(np.array([0.975]))[0] == pytest.approx(1.959964, abs=1e-6)
    assert S.studentized_range_sf(3.578, 3, 20) == pytest.approx(0.05, abs=2e-4)
    assert S.studentized_range_sf(3.314, 3, 1e9) == pytest.approx(0.05, abs=2e-4)
    w, p = S.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (round(w, 4), round(p, 4)) == (0.7888, 0.0067)
    assert S.mann_whitney_exact(0, 3, 3) == pytest.approx(0.1)


def test_studentised_range_at_any_degrees_of_freedom():
    x = np.linspace(-9, 9, 20001)
    density, below = np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1 - S.normal_sf(x)
    for q, k in ((3.3, 3), (4.1, 5), (1.0, 2)):
        limit = 1 - k * np.trapezoid(density * (below - (1 - S.normal_sf(x - q))) ** (k - 1), x)
        p = [float(S.studentized_range_sf(q, k, nu)) for nu in (20.0, 1e3, 2e4, 3e4, 1e6, 1e9, 1e15)]
        assert all(a > b - 1e-12 for a, b in zip(p, p[1:], strict=False))  # falls to the limit
        assert p[-1] == pytest.approx(limit, rel=1e-6) and p[3] - limit == pytest.approx((p[2] - limit) * 2 / 3, rel=1e-2)


def test_kruskal_and_anova_by_hand(spark):
    h = G.kruskal_wallis(frame(spark), ["metric"], "grp", "value").first()
    values = sorted(A + B + C)
    rank = {v: np.mean([i + 1 for i, x in enumerate(values) if x == v]) for v in values}
    n = len(values)
    want = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in g) ** 2 / len(g) for g in (A, B, C)) - 3 * (n + 1)
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    want /= 1 - ties / (n**3 - n)
    assert h["statistic"] == pytest.approx(want) and h["n"] == n and h["p"] == pytest.approx(math.exp(-want / 2))
    f = G.anova_oneway(frame(spark), ["metric"], "grp", "value").first()
    grand = np.mean(A + B + C)
    ssb = sum(len(g) * (np.mean(g) - grand) ** 2 for g in (A, B, C))
    ssw = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in (A, B, C))
    assert f["statistic"] == pytest.approx(ssb / 2 / (ssw / (n - 3)))
    assert f["p"] == pytest.approx(float(S.f_sf(f["statistic"], 2, n - 3)))


def test_two_groups_agree(spark):
    two = frame(spark, (A, B))
    t = G.ttest_ind(two, ["metric"], "grp", "value").first()
    f = G.anova_oneway(two, ["metric"], "grp", "value").first()
    assert t["t"] ** 2 == pytest.approx(f["statistic"]) and t["p"] == pytest.approx(f["p"])
    q = G.tukey_hsd(two, ["metric"], "grp", "value").first()
    assert q["p"] == pytest.approx(f["p"], abs=2e-3)  # for two groups the range test is the t test


def test_omnibus_and_posthoc(spark):
    groups = [list(m + S.normal_ppf((np.arange(30) + 0.5) / 30)) for m in (0, 0.2, 2.0)]
    df = frame(spark, groups)
    o = G.omnibus_select(df, ["metric"], "grp", "value")
    row = o.first()
    assert row["test"] == "ANOVA" and row["all_normal"] and row["p"] < 1e-6
    post = {(r["g1"], r["g2"]): r for r in G.posthoc_pairs(df, ["metric"], "grp", "value", o).collect()}
    assert post["a", "c"]["significant"] and not post["a", "b"]["significant"] and post["a", "c"]["posthoc"] == "Tukey HSD"


def test_fdr(spark):
    rows = [("x", i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04, 0.05])] + [("y", 9, 0.2), ("y", 10, None)]
    got = {r["i"]: r["p_fdr"] for r in G.fdr_bh(spark.createDataFrame(rows, "f string, i int, p double"), ["f"], order=["i"]).collect()}
    assert all(got[i] == pytest.approx(0.05) for i in range(5)) and got[9] == pytest.approx(0.2) and got[10] is None


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 4.0), (3.0, 5.0), (5.0, 5.5), (None, 1.0)], "x double, y double")
    assert sorted(r["rank"] for r in G.average_ranks(df.na.drop(), [], "x").collect()) == [1, 2.5, 2.5, 4, 5]
    r = G.pearson_corr(df, [], "x", "y").first()
    assert r["n"] == 5 and r["r"] == pytest.approx(np.corrcoef([1, 2, 2, 3, 5], [2, 1, 4, 5, 5.5])[0, 1])


def test_reml_equals_anova_when_balanced(spark):
    rng = np.random.default_rng(0)
    rows = [(s, "g", float(b + e)) for s, b in enumerate(rng.normal(0, 2, 12)) for e in rng.normal(0, 1, 6)]
    df = spark.createDataFrame(rows, "s int, g string, y double")
    a = M.icc_anova(df, [], "s", "y").first()
    m = M.mixed_model(df.withColumn("k", df["g"]), ["k"], "s", "y", "g", "g", ["g"]).first()
    assert m["icc"] == pytest.approx(a["icc"], abs=1e-4) and m["beta"] == pytest.approx(np.mean([r[2] for r in rows]))


def test_mediation_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    m = 0.8 * x + rng.normal(size=200)
    y = 0.5 * m + 0.3 * x + rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, m, y, strict=True))], "i int, x double, m double, y double")
    r = M.bootstrap_mediation(df, [], "x", "m", "y", "i", 200).first()
    beta = np.linalg.lstsq(np.c_[np.ones(200), x, m], y, rcond=None)[0]
    assert r["direct"] == pytest.approx(beta[1]) and r["b"] == pytest.approx(beta[2])
    assert r["total"] == pytest.approx(r["direct"] + r["indirect"]) and r["low"] < r["indirect"] < r["high"]
    o = {q["term"]: q["beta"] for q in M.ols_multi(df, [], "y", ["x", "m"]).collect()}
    assert o["x"] == pytest.approx(beta[1]) and o["intercept"] == pytest.approx(beta[0])


def test_shapiro_at_every_size(spark):
    g = np.random.default_rng(3)
    groups = {f"n{n}": g.normal(1e3, 2, n) for n in (1, 2, 3, 4, 5, 6, 11, 12, 200, 7000)} | {"skew": g.exponential(size=6000), "ties": g.integers(0, 9, 300), "flat": np.ones(9)}
    df = spark.createDataFrame([("m", k, float(v)) for k, x in groups.items() for v in x], "metric string, grp string, value double")
    got = {r["grp"]: r for r in G.shapiro_wilk(df, ["metric"], "grp", "value").collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        w, p = S.shapiro_wilk(x)
        if math.isnan(w):
            assert got[k]["statistic"] is None and got[k]["p"] is None and not got[k]["is_normal"]
        else:
            assert got[k]["statistic"] == pytest.approx(w, abs=1e-8) and got[k]["p"] == pytest.approx(p, abs=1e-5), k
    assert got["n7000"]["is_normal"] and not got["skew"]["is_normal"]
