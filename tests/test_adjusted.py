"""Contrasts, mediation of many pairs, quantile plots, paths and eye-channel scores, against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.operators import models as M
from wavecohort.operators import network as N
from wavecohort.operators import signal as S


def test_contrasts_of_a_balanced_table(spark):
    """Three groups of six subjects with four rows each at the same ages: by hand, the means of the groups' means."""
    rng = np.random.default_rng(3)
    rows = [(g, f"{g}{s}", float(age), float(up + bend * (age - 9) + 0.5 * shift + rng.normal(0, 0.2))) for g, up, bend in (("a", 10, 1.0), ("b", 12, 2.0), ("c", 9, 1.0)) for s, shift in enumerate(rng.normal(size=6)) for age in (6, 8, 10, 12)]
    df = spark.createDataFrame(rows, "grp string, subject string, age double, y double").withColumn("k", F.lit(1))
    for by_group in (None, ["age"]):
        got = {(r["g1"], r["g2"]): r for r in M.adjusted_contrasts(df, ["k"], "subject", "y", "grp", ["a", "b", "c"], ["age"], by_group).collect()}
        per = {}
        for g, s, _, y in rows:
            per.setdefault(g, {}).setdefault(s, []).append(y)
        mean = {g: np.mean([np.mean(v) for v in s.values()]) for g, s in per.items()}
        between = np.mean([np.var([np.mean(v) for v in s.values()], ddof=1) for s in per.values()])  # of subjects' means
        assert sorted(got) == [("a", "b"), ("a", "c"), ("b", "c")]
        for (g, h), r in got.items():
            assert (r["mean1"], r["mean2"], r["diff"]) == pytest.approx((mean[g], mean[h], mean[g] - mean[h]), abs=1e-6)
            if by_group:  # one slope for all leaves so much within subjects that nothing is left between them
                assert r["se"] == pytest.approx((between * 2 / 6) ** 0.5, rel=1e-3)
            assert r["p_adjusted"] == pytest.approx(min(1, 3 * r["p"])) and r["low"] < r["diff"] < r["high"]
    assert M.adjusted_contrasts(df.filter("grp <> 'c'"), ["k"], "subject", "y", "grp", ["a", "b", "c"], ["age"]).count() == 0
    assert M.adjusted_contrasts(df.limit(0), ["k"], "subject", "y", "grp", ["a", "b", "c"], ["age"]).count() == 0


def test_all_pairs_equal_pair_by_pair(spark):
    rng = np.random.default_rng(6)
    n = 80
    v = rng.normal(3, 1, (n, 6))
    v[:, 1] += v[:, 0] + 0.5 * v[:, 5]
    v[:, 3] += v[:, 1]
    rows = [(i, *map(float, r)) for i, r in enumerate(v)]
    rows = [(i, a, None if i % 7 == 0 else b, c, float("nan") if i % 11 == 0 else d, e, f) for i, a, b, c, d, e, f in rows] + [(n, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, x double, m1 double, m2 double, y1 double, y2 double, age double").withColumn("k", F.lit(1)).repartition(3)
    for cov in (["age"], None):
        got = {(r["mediator"], r["outcome"]): r for r in M.batch_mediation(df, "x", ["m1", "m2"], ["y1", "y2"], "i", 130, covariates=cov).collect()}
        assert len(got) == 4
        for (m, y), r in got.items():
            one = M.bootstrap_mediation(df, ["k"], "x", m, y, "i", 130, covariates=cov).first()
            for c in ("n", "a", "b", "direct", "total", "indirect", "low", "high", "p", "proportion"):
                assert r[c] == pytest.approx(one[c], abs=1e-9), (m, y, c)


def test_quantile_points(spark):
    x = np.random.default_rng(2).normal(4, 2, 501)
    df = spark.createDataFrame([("k", float(v)) for v in x] + [("k", None), ("k", float("nan")), (None, 5.0)], "k string, v double")
    got = M.qq_points(df, ["k"], "v", 9).collect()
    own = sorted((r["p"], r["sample"], r["normal"]) for r in got if r["k"] == "k")
    assert [s for _, s, _ in own] == pytest.approx(list(np.quantile(x, np.arange(1, 10) / 10)))
    assert own[4][2] == pytest.approx(0) and own[0][2] == pytest.approx(-1.2815516)
    assert [r["sample"] for r in got if r["k"] is None] == [5.0] * 9


def test_paths_by_joins_equal_the_matrix_way(spark):
    rng = np.random.default_rng(7)
    rows = [(k, f"n{i:02d}", f"n{j:02d}", float(rng.random() + 0.05)) for k in ("dense", "sparse") for i, j in itertools.combinations(range(14), 2) if k == "dense" or rng.random() < 0.13]
    rows += [("two", "a", "b", 1.0), ("two", "b", "c", 2.0), ("two", "x", "y", 5.0), ("two", "y", "z", 0.0), ("none", "a", "b", 0.0), ("line", *("p", "q", 1.0))]
    rows += [("chain", f"c{i:02d}", f"c{i + 1:02d}", 0.5) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, ch1 string, ch2 string, weight double").repartition(3)
    for distance in ("weight", "inverse"):
        one = {r["k"]: r["path_length"] for r in N.path_length(df, ["k"], distance).collect()}
        two = N.path_length_joined(df, ["k"], distance)
        plan = two._jdf.queryExecution().toString()
        assert "Pandas" not in plan and "Cartesian" not in plan  # no task holds a network
        two = {r["k"]: r["path_length"] for r in two.collect()}
        assert two.keys() == one.keys() and two["none"] is None
        assert {k: v for k, v in two.items() if v is not None} == pytest.approx({k: v for k, v in one.items() if v is not None and not np.isnan(v)})
    assert two["two"] == pytest.approx((1 + 0.5 + 1.5) * 2 / 6)  # of a, b, c by 1 / weight


def test_eye_scores_go_on_until_no_channel_is_added(spark):
    """The second channel hides behind the first: it stands out only once that is left out."""
    rng = np.random.default_rng(1)
    t = 400
    eye = rng.normal(size=t)
    mix = {"a": 0.999, "b": 0.60, **{f"c{i}": 0.02 * i for i in range(12)}}
    rows = [("s", i, "eog", float(eye[i])) for i in range(t)]
    for c, w in mix.items():
        other = rng.normal(size=t)
        other -= eye * (other @ eye) / (eye @ eye)
        rows += [("s", i, c, float(v)) for i, v in enumerate(w * eye / eye.std() + (1 - w * w) ** 0.5 * other / other.std())]
    rows += [("s", i, "flat", 1.0) for i in range(t)]
    df = spark.createDataFrame(rows, "s string, t int, ch string, v double")
    got = {r["ch"]: r for r in S.artifact_scores(df, ["s"], ["t"], "ch", "v", "eog", 2.5).collect()}
    score = {c: abs(np.corrcoef([r[3] for r in rows if r[2] == c], eye)[0, 1]) for c in mix}
    first = (np.array(list(score.values())) - np.mean(list(score.values()))) / np.std(list(score.values()))
    assert [c for c, z in zip(score, first, strict=True) if z > 2.5] == ["a"]  # one round finds one
    assert {c for c, r in got.items() if r["flagged"]} == {"a", "b"}
    left = [v for c, v in score.items() if c not in ("a", "b")]
    for c in mix:
        assert got[c]["z"] == pytest.approx((score[c] - np.mean(left)) / np.std(left), rel=1e-6)
    assert got["flat"]["score"] is None and not got["flat"]["flagged"]


def test_a_large_list_of_channels_is_not_broadcast(spark, monkeypatch):
    from wavecohort.operators import select

    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "d", 4.0)], "ch1 string, ch2 string, weight double").withColumn("k", F.lit(1))
    rois = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("y", "c")], "roi string, channel string")
    few = sorted((r["roi"], r["weight"]) for r in N.roi_within(edges, ["k"], rois).collect())
    monkeypatch.setattr(select, "MAX_SIDE", 2)
    many = N.roi_within(edges, ["k"], rois)
    assert few == [("x", 1.0), ("y", 2.0)] == sorted((r["roi"], r["weight"]) for r in many.collect())
    assert "strategy=broadcast" not in many._jdf.queryExecution().logical().toString()
