"""Resamples drawn from streams of bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort import jobs
from wavecohort.operators import models as M
from wavecohort.operators import permute as P

from .conftest import DATA

BITS = 2**64 - 1


def _mix(z):
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & BITS
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & BITS
    return z ^ (z >> 31)


def _number(seed, rep):
    """A row's draws in a resample, spelt out."""
    z = _mix((seed + (rep // 4 + 1) * 0x9E3779B97F4A7C15) & BITS)
    u = z >> 16 * (rep % 4) & 0xFFFF
    chance = [np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(20)]
    whole = [int(p * 65536) if k < 6 else 0 for k, p in enumerate(chance)]
    if u < sum(whole):
        return sum(u >= sum(whole[:k]) for k in range(1, 6))
    v = (_mix((z + (rep % 4 + 1) * 0x94D049BB133111EB) & BITS) >> 11) / 2**53
    left = np.cumsum([p - w / 65536 for p, w in zip(chance, whole, strict=True)])
    return int((v >= left / left[-1]).sum())


def test_numbers_are_poisson_and_rows_and_resamples_apart():
    seeds = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    w = P.poisson_draws(seeds, range(0, 250))
    assert w.shape == (3000, 1000) and [[_number(int(s), r) for r in range(1000)] for s in seeds[:30]] == w[:30].tolist()
    assert (P.poisson_draws(seeds, range(7, 9)) == w[:, 28:36]).all()
    found, want = np.bincount(w.ravel(), minlength=20)[:9], P._CHANCES[:9] * w.size
    assert (np.abs(found - want) < 5 * np.sqrt(want)).all() and w.max() > 7
    for part in (w[:, :300].T, w[:300]):
        assert np.abs(np.corrcoef(part.astype(float)) - np.eye(300)).max() < 0.2
    total, v = np.zeros((999, 2)), np.random.default_rng(1).normal(size=(2, 3000))
    P.add_resampled(total, seeds, v)
    assert total == pytest.approx(w[:, :999].T @ v.T, abs=1e-8)


def test_streamed_resamples_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, *map(float, rng.normal(3, 1, 3))) for k in range(60) for i in range(12)]  # more keys than a task holds
    df = spark.createDataFrame(rows, "k int, i int, x double, m double, y double")
    got = [{(r["k"], r["rep"]): r["indirect"] for r in M.bootstrap_effects(df.repartition(n), ["k"], "x", "m", "y", "i", 63, draws="stream").collect()} for n in (1, 5)]
    seeds = [r["s"] & BITS for r in spark.range(12).select(F.xxhash64(F.lit(42), F.col("id").cast("string")).alias("s")).collect()]
    for k, rep in ((0, 0), (0, 62), (41, 51), (59, 7)):
        x, m, y = np.repeat([r[2:] for r in rows if r[0] == k], [_number(s, rep) for s in seeds], axis=0).T
        a = np.cov(x, m)[0, 1] / np.var(x, ddof=1)
        b = np.linalg.lstsq(np.c_[np.ones(len(x)), x, m], y, rcond=None)[0][2]
        assert got[0][k, rep] == pytest.approx(a * b, abs=1e-9)
    assert len(got[0]) == 60 * 63 and got[0] == pytest.approx(got[1], abs=1e-9)


@pytest.mark.parametrize("name", ["bootstrap_effects_whole", "percentile_ci_whole", "bootstrap_mediation_whole", "mediation_summary", "batch_mediation"])
def test_whole_queries_draw_from_streams(spark, monkeypatch, name):
    asked, boot = [], M.bootstrap_effects
    monkeypatch.setattr(M, "bootstrap_effects", lambda *a, **b: asked.append((a[6], b.get("draws"))) or boot(*a, **b))
    got = jobs.QUERIES[name](spark, DATA)
    assert asked == [(5000, "stream")] and got.count() > 0
