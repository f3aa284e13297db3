"""The tail probabilities as columns. They run on tables of results, a row for each test; normal scores alone run on
measurements, in Arrow batches."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wavecohort.functions import special


@F.pandas_udf(DoubleType())
def _normal2(z: pd.Series) -> pd.Series:
    return pd.Series(2 * special.normal_sf(z.abs()))


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.chi2_sf(x, df))


@F.pandas_udf(DoubleType())
def _f(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(special.f_sf(x.to_numpy(), d1.to_numpy(), d2.to_numpy()))


@F.pandas_udf(DoubleType())
def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.t_two_sided(t.to_numpy(), df.to_numpy()))


@F.pandas_udf(DoubleType())
def _range(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.studentized_range_sf(q.to_numpy(), k.to_numpy(), df.to_numpy()))


@F.pandas_udf(DoubleType())
def _score(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return pd.Series([inverse(x) for x in p], dtype=float)


@F.pandas_udf(StructType([StructField("plain", DoubleType()), StructField("square", DoubleType())]))
def _score_sums(n: pd.Series, i: pd.Series, j: pd.Series) -> pd.DataFrame:
    inverse = NormalDist().inv_cdf
    plain, square = [], []
    for size, a, b in zip(n, i, j, strict=True):
        m = [inverse((x - 0.375) / (size + 0.25)) for x in range(int(a), int(b) + 1)]
        plain.append(sum(m))
        square.append(sum(x * x for x in m))
    return pd.DataFrame({"plain": plain, "square": square})


@F.pandas_udf(DoubleType())
def _shapiro_w(n: pd.Series, mm: pd.Series, mx: pd.Series, ss: pd.Series, first: pd.Series, second: pd.Series, before: pd.Series, last: pd.Series, m_before: pd.Series, m_last: pd.Series) -> pd.Series:
    rows = zip(n, mm, mx, ss, first, second, before, last, m_before, m_last, strict=True)
    return pd.Series([special.shapiro_from_sums(*r) for r in rows], dtype=float)


@F.pandas_udf(DoubleType())
def _shapiro_p(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([special.shapiro_p(*r) for r in zip(w, n, strict=True)], dtype=float)


def _shown(p: Column, *of: Column) -> Column:
    """Null where an argument is null or no number."""
    ok = F.lit(True)
    for c in of:
        ok = ok & c.isNotNull() & ~F.isnan(c)
    return F.when(ok, p)


def _d(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("double")


def normal_p(z) -> Column:
    return _shown(_normal2(_d(z)), _d(z))


def chi2_p(x, df) -> Column:
    return _shown(_chi2(_d(x), _d(df)), _d(x), _d(df))


def f_p(x, d1, d2) -> Column:
    return _shown(_f(_d(x), _d(d1), _d(d2)), _d(x), _d(d1), _d(d2))


def t_p(t, df) -> Column:
    return _shown(_t(_d(t), _d(df)), _d(t), _d(df))


def range_p(q, k, df) -> Column:
    return _shown(_range(_d(q), _d(k), _d(df)), _d(q), _d(k), _d(df))


def normal_score(p) -> Column:
    """The normal quantile of a probability between 0 and 1."""
    return _score(_d(p))


def normal_score_sums(n, i, j) -> Column:
    """``plain`` and ``square``: the sums of the normal scores of the places i to j among n, and of their squares."""
    return _score_sums(*[(c if isinstance(c, Column) else F.col(c)).cast("long") for c in (n, i, j)])


def shapiro_w(*sums) -> Column:
    """W from the sums that :func:`special.shapiro_from_sums` takes; null where it has none."""
    return F.nullif(_shapiro_w(*[_d(c) for c in sums]), F.lit(float("nan")))


def shapiro_p(w, n) -> Column:
    return _shown(_shapiro_p(_d(w), _d(n)), _d(w), _d(n))
