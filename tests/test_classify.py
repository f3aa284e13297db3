"""Permutation tests of the classifier against brute force, fit by fit."""

import hashlib

import numpy as np
import pytest

from wavecohort.operators import classify as C


def brute(x, y, fold, ridge):
    guess = np.zeros(len(y), int)
    for i in np.unique(fold):
        train, test = fold != i, fold == i
        if len(set(y[train])) == 1:
            guess[test] = y[train][0]
            continue
        sd = x[train].std(axis=0)
        sd = np.where(sd > 1e-9, sd, 1)
        z = (x - x[train].mean(axis=0)) / sd
        m1, m0 = z[train & (y == 1)].mean(axis=0), z[train & (y == 0)].mean(axis=0)
        w = np.linalg.solve(z[train].T @ z[train] / train.sum() + ridge * np.eye(x.shape[1]), m1 - m0)
        guess[test] = z[test] @ w > w @ (m1 + m0) / 2
    hit = guess == y
    return hit.mean(), (hit[y == 1].mean() + hit[y == 0].mean()) / 2


def table(n, d, seed, lift=0.0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(5, [1, *[3] * (d - 1)], (n, d)) + lift * y[:, None]
    x[:, -1] = 7.0  # no spread
    return x, y, rng.integers(0, 3, n)


def test_every_shuffle_equals_brute_force(spark, monkeypatch):
    x, y, fold = table(57, 6, 3, 1.0)
    ids = [f"s{i}" for i in range(57)]
    df = spark.createDataFrame([(i, v.tolist(), int(c), int(f)) for i, v, c, f in zip(ids, x, y, fold, strict=True)], "id string, x array<double>, y int, f int").repartition(5)
    monkeypatch.setattr(C, "COEFFICIENTS_MB", 8 * 3 * 7 * 40 / 2**20)  # 40 shuffles at once
    got = {r["perm"]: (r["accuracy"], r["balanced"]) for r in C.permutation_accuracy(df, "x", "y", "f", "id", 130).collect()}
    assert sorted(got) == list(range(-1, 130))
    assert got[-1] == pytest.approx(brute(x, y, fold, 0.1))
    for p in range(130):
        order = sorted(range(57), key=lambda j: hashlib.md5(f"42|{p}|{ids[j]}".encode()).hexdigest())  # noqa: B023
        shuffled = np.zeros(57, int)
        shuffled[order[: y.sum()]] = 1
        assert got[p] == pytest.approx(brute(x, shuffled, fold, 0.1)), p


def test_p_values_tell_signal_from_noise(spark):
    for lift, low, high in ((3.0, 0.0, 0.02), (0.0, 0.05, 1.0)):
        x, y, fold = table(90, 4, 11, lift)
        df = spark.createDataFrame([(i, v.tolist(), int(c), int(f)) for i, (v, c, f) in enumerate(zip(x, y, fold, strict=True))], "id int, x array<double>, y int, f int")
        got = C.permutation_p(C.permutation_accuracy(df, "x", "y", "f", "id", 99)).first()
        assert low < got["p_balanced"] <= high and got["n_perms"] == 99


def test_degenerate_tables(spark):
    schema = "id int, x array<double>, y int, f int"
    assert C.permutation_accuracy(spark.createDataFrame([], schema), "x", "y", "f", "id", 5).count() == 0
    assert C.permutation_accuracy(spark.createDataFrame([(1, [1.0], 1, 0), (2, [2.0], 1, 1)], schema), "x", "y", "f", "id", 5).count() == 0
    rows = [(1, [1.0], 1, 0), (2, [2.0], 0, 1), (3, None, 1, 1), (4, [None], 0, 0), (5, [3.0], None, 0)]
    got = C.permutation_accuracy(spark.createDataFrame(rows, schema), "x", "y", "f", "id", 3).collect()
    assert len(got) == 4 and all(r["accuracy"] in (0.0, 0.5, 1.0) for r in got)
    wide = spark.createDataFrame([(1, [0.0] * 1001, 1, 0), (2, [1.0] * 1001, 0, 1)], schema)
    with pytest.raises(ValueError, match="1001 features"):
        C.permutation_accuracy(wide, "x", "y", "f", "id", 3)
