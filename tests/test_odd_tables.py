"""Queries on tables that are odd or grown, against their SQL."""

import duckdb
import numpy as np
import pytest

from wavecohort import jobs
from wavecohort.operators import models as M

from .conftest import DATA
from .test_queries import rows


def _equal(spark, folder, name, table):
    """The query and its SQL on a folder that holds one table."""
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = c.sql(jobs.SQL[name])
    columns = sorted(want.columns)
    got = jobs.QUERIES[name](spark, str(folder))
    assert sorted(got.columns) == columns
    got, want = [r.asDict() for r in got.collect()], [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(columns, got) == rows(columns, want)
    return got


def test_channels_without_all_good_neighbours_are_not_interpolated(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(26, 64)).astype("float32").tolist()  # the last epoch has two of four channels
    v[4], v[10], v[12][5], v[18] = None, v[10][:40], None, v[18] + [1.0, 2.0]
    data = [(i, x) for i, x in enumerate(v) if i != 22] + [(20, v[0]), (None, v[1])]  # c2 is gone, c0 is there twice
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = _equal(spark, tmp_path, "interpolate_bad_channels", "embeddings")
    made = {(r["epoch_idx"], r["sample_idx"]): r["value"] for r in got if r["channel"] == "c1"}
    assert {e for e, _ in made} == {0, 1, 2, 3, 4, 5} and made[1, 0] is None and made[3, 5] is None and made[0, 0] is not None


def test_residuals_are_summed_up_by_ranges_of_values(spark):
    """An exact percentile as an aggregate holds the distinct values of a key in one task."""
    plan = jobs.QUERIES["residual_diagnostics"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    rng = np.random.default_rng(4)
    values = {k: rng.normal(0.01, 2, n).round(2) for k, n in (("a", 4000), ("b", 37), ("c", 1))}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("a", None)], "k string, v double").repartition(5)
    got = {r["k"]: r for r in M.residual_summary(df, ["k"], "v", {"low": 0.05, "high": 0.95}).collect()}
    for k, x in values.items():
        r = got.pop(k)
        assert r["n"] == len(x) and (r["mean"], r["low"], r["high"]) == pytest.approx((x.mean(), *np.quantile(x, [0.05, 0.95])))
        assert r["sd"] == (pytest.approx(x.std(ddof=1)) if len(x) > 1 else None)
    assert not got
