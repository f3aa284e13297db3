"""Mediation with covariates against plain least squares on a small table."""

import numpy as np
import pandas as pd
import pytest

from wavecohort.operators import models as M


def _fit(y, *xs):
    z = np.column_stack([np.ones(len(y)), *xs])
    beta, *_ = np.linalg.lstsq(z, y, rcond=None)
    rest = y - z @ beta
    cov = np.linalg.inv(z.T @ z) * (rest @ rest) / (len(y) - z.shape[1])
    return beta[1:], np.sqrt(np.diag(cov))[1:]


def _data():
    rng = np.random.default_rng(5)
    n = 80
    c, x = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    m = 0.8 * x + 0.5 * c + rng.normal(size=n)
    return pd.DataFrame({"k": "a", "row": np.arange(n), "x": x, "m": m, "y": 0.6 * m - 0.3 * c + rng.normal(size=n), "c": c})


def test_paths_with_a_covariate(spark):
    f = _data()
    got = M.mediation_paths(spark.createDataFrame(f), ["k"], "x", "m", "y", ["c"]).first()
    (a, _), (sa, _) = _fit(f.m, f.x, f.c)
    (direct, b, _), (sd, sb, _) = _fit(f.y, f.x, f.m, f.c)
    (total, _), (st, _) = _fit(f.y, f.x, f.c)
    for name, want in (("a", a), ("a_se", sa), ("b", b), ("b_se", sb), ("direct", direct), ("direct_se", sd), ("total", total), ("total_se", st)):
        assert abs(got[name] - want) < 1e-9
    assert got["n"] == len(f) and got["b_p"] < 0.01


def test_resamples_with_a_covariate(spark):
    f = _data()
    df = spark.createDataFrame(f)
    boot = {r["rep"]: r["indirect"] for r in M.bootstrap_effects(df, ["k"], "x", "m", "y", "row", 5, covariates=["c"]).collect()}
    for rep in range(5):
        u = (M.digests(42, range(rep, rep + 1), [f"{i}".encode() for i in f["row"]])[0][0] >> np.uint64(12)).astype(float) / 2.0**52
        g = f.loc[f.index.repeat(np.searchsorted(M._POISSON, u, side="right"))]
        want = _fit(g.m, g.x, g.c)[0][0] * _fit(g.y, g.x, g.m, g.c)[0][1]
        assert abs(boot[rep] - want) < 1e-9
    row = M.mediation_table(df, ["k"], "x", "m", "y", "row", 60, covariates=["c"]).first()
    assert row["low"] < row["indirect"] < row["high"] and row["p_fdr"] == row["p"]


def test_resamples_of_few_rows_are_dealt_over_all_tasks(spark):
    """A row costs a hash for each resample: a small file's rows do not stay in the task that reads them."""
    df = spark.createDataFrame([(i, "a", float(i % 7), float(i % 5), float(i % 3)) for i in range(400)], "i int, k string, x double, m double, y double").coalesce(1)
    n = spark.sparkContext.defaultParallelism
    one = M.bootstrap_effects(df, [], "x", "m", "y", "i", 20)
    pairs = M.bootstrap_effects(df, ["k"], "x", ["m"], ["y"], "i", 20)
    for got in (one, pairs):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert any("hashpartitioning(__row" in x and f", {n}), REPARTITION_BY_NUM" in x for x in plan.splitlines())
    want = {r["rep"]: r["indirect"] for r in one.collect()}
    rows = {r["rep"]: r for r in pairs.collect()}
    assert rows.pop(-1)["n"] == 400 and {k: r["indirect"] for k, r in rows.items()} == pytest.approx(want, abs=1e-9)
