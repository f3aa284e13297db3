"""Group summaries and group tests, for all keys (metric, band, ...) in one job.

Every function takes a long table with key columns, a group column and a value column. Summaries are partial
aggregations, so a hot key costs no more than others; only ranks and exact medians sort, and they sort counts of distinct
values in ranges of (key, value), never a key in one task.
Null and NaN values, and null groups, have no part. Variances are of samples; a zero denominator gives null.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wavecohort.functions import special
from wavecohort.functions.pvalues import chi2_p, f_p, normal_p, normal_score, normal_score_sums, range_p, shapiro_p, shapiro_w, t_p
from wavecohort.functions.scratch import written
from wavecohort.operators.placed import at_place, distribution, join_keys, lowest_from_here, quantiles, running


def _values(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*keys, F.col(group).alias("grp"), v.alias("v")).filter(F.col("grp").isNotNull() & v.isNotNull() & ~F.isnan(v))


def over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def descriptive_stats(df: DataFrame, keys: list[str], group: str, value: str, approximate: bool = False) -> DataFrame:
    """``n, mean, std, median, q25, q75, min, max`` per keys and group. ``approximate``: quantiles from a mergeable
    sketch, for keys with so many distinct values that a map of them does not fit a task."""
    q = F.percentile_approx("v", [0.25, 0.5, 0.75], 10_000) if approximate else F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    got = _values(df, keys, group, value).groupBy(*keys, "grp").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), q.alias("q"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    return got.select(*keys, "grp", "n", "mean", "std", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "min", "max")


def group_moments(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``n, mean, var`` per keys and group: all that the tests on means need."""
    return _values(df, keys, group, value).groupBy(*keys, "grp").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))


def _between(m: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of squares between and within groups, from moments."""
    sums = m.groupBy(*keys).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"),
        F.collect_list(F.struct("n", "mean")).alias("g"),  # a row for each group
    )
    ssb = F.aggregate("g", F.lit(0.0), lambda a, x: a + x["n"] * (x["mean"] - F.col("grand")) * (x["mean"] - F.col("grand")))
    return sums.withColumn("ssb", ssb).drop("g", "grand")


def anova_from_moments(m: DataFrame, keys: list[str]) -> DataFrame:
    s = _between(m, keys)
    f = over(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("total") - F.col("k")))
    sst = F.col("ssb") + F.col("ssw")
    return s.select(*keys, "k", F.col("total").alias("n"), f.alias("statistic"), F.when(sst > 0, F.col("ssb") / sst).otherwise(0.0).alias("effect_size")).withColumn(
        "p", f_p("statistic", F.col("k") - 1, F.col("n") - F.col("k"))
    )


def anova_oneway(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``k, n, statistic (F), effect_size (eta squared), p``."""
    return anova_from_moments(group_moments(df, keys, group, value), keys)


def medians(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    return quantiles(_values(df, keys, group, value), [*keys, "grp"], "v", {"med": 0.5})


def levene(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Homogeneity of variances: the analysis of variance of distances from each group's median."""
    rows = _values(df, keys, group, value)
    mid = medians(df, keys, group, value)
    away = rows.join(mid, [*keys, "grp"]).select(*keys, "grp", F.abs(F.col("v") - F.col("med")).alias("away"))
    return anova_oneway(away, keys, "grp", "away").withColumnRenamed("effect_size", "share").drop("share")


def alexander_govern(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Equality of means under unequal variances: ``k, n, statistic (A, chi-squared with k-1 df), effect_size, p``."""
    m = group_moments(df, keys, group, value).filter((F.col("n") > 1) & (F.col("var") > 0))
    w = Window.partitionBy(*keys)  # groups of a key
    m = m.withColumn("w", F.col("n") / F.col("var")).withColumn("centre", F.sum(F.col("w") * F.col("mean")).over(w) / F.sum("w").over(w))
    t = (F.col("mean") - F.col("centre")) / F.sqrt(F.col("var") / F.col("n"))
    nu = F.col("n") - 1
    a = nu - 0.5
    b = 48 * a * a
    c = F.sqrt(a * F.log1p(t * t / nu))
    z = c + (F.pow(c, 3) + 3 * c) / b - (4 * F.pow(c, 7) + 33 * F.pow(c, 5) + 240 * F.pow(c, 3) + 855 * c) / (10 * b * b + 8 * b * F.pow(c, 4) + 1000 * b)
    a_sum = m.withColumn("z2", z * z).groupBy(*keys).agg(F.sum("z2").alias("statistic"))
    size = anova_from_moments(group_moments(df, keys, group, value), keys).select(*keys, "k", "n", "effect_size")
    return size.join(a_sum, keys).withColumn("p", chi2_p("statistic", F.col("k") - 1))


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str = "rank") -> DataFrame:
    """Every row with the average rank of its value within its keys. Only distinct values with their counts are
    sorted, and joined back; a null value has a null rank."""
    d = distribution(df, keys, value).select(*keys, value, (F.col("before") + (F.col("t") + 1) / 2).alias(rank))
    return join_keys(df, d, [*keys, value], "left").select(*df.columns, rank)


def rank_sums(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``n, r`` per keys and group, with ``total`` and ``ties`` (sum of t^3 - t) of the keys. The rows are folded into
    counts of (group, value) before anything is sorted."""
    by = written(_values(df, keys, group, value).groupBy(*keys, "v", "grp").agg(F.count("*").alias("c")), "counts")
    t = by.groupBy(*keys, "v").agg(F.sum("c").alias("t"))
    d = running(t, keys, ["v"], "t", "before", "n").select(*keys, "v", "t", (F.col("before") + (F.col("t") + 1) / 2).alias("rank"))
    whole = t.groupBy(*keys).agg(F.sum("t").alias("total"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    sums = join_keys(by, d.drop("t"), [*keys, "v"]).groupBy(*keys, "grp").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    return join_keys(sums, whole, keys)


def kruskal_wallis(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``k, n, statistic (H, tie-corrected), effect_size (epsilon squared), p``."""
    s = rank_sums(df, keys, group, value).groupBy(*keys).agg(
        F.count("*").alias("k"), F.first("total").alias("n"), F.first("ties").alias("ties"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")
    )
    n = F.col("n").cast("double")
    h = over(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    return s.withColumn("statistic", h).select(
        *keys, "k", "n", "statistic", F.when(F.col("n") > F.col("k"), (F.col("statistic") - F.col("k") + 1) / (F.col("n") - F.col("k"))).otherwise(0.0).alias("effect_size")
    ).withColumn("p", F.when(F.col("k") == 3, F.exp(-F.col("statistic") / 2)).otherwise(chi2_p("statistic", F.col("k") - 1)))


def jarque_bera(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Normality from skewness and kurtosis, one pass: ``n, statistic, p, is_normal`` per keys and group; it sorts
    nothing, where :func:`shapiro_wilk` sorts every group."""
    got = _values(df, keys, group, value).groupBy(*keys, "grp").agg(F.count("v").alias("n"), F.skewness("v").alias("s"), F.kurtosis("v").alias("c"))
    stat = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("c") * F.col("c") / 4)
    got = got.withColumn("statistic", stat).withColumn("p", F.exp(-F.col("statistic") / 2))
    return got.select(*keys, "grp", "n", "statistic", "p", F.coalesce((F.col("n") >= 3) & (F.col("p") > 0.05), F.lit(False)).alias("is_normal"))


#: Places of one value whose normal scores are added up at once.
PLACES_AT_ONCE = 10_000


def shapiro_wilk(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``n, statistic (W), p, is_normal`` per keys and group, by the same test at every size. Distinct values get their
    places in their group, by ranges of values over all tasks, and the sum of these places' normal scores; W then takes sums,
    the two values at either end and their scores. p is fitted to 5,000 values at most and extrapolated beyond. Under three
    values, or all alike: no W, not normal."""
    rows = _values(df, keys, group, value)
    by = [*keys, "grp"]
    d = written(distribution(rows, by, "v"), "places")
    end = F.col("n")
    ends = d.groupBy(*by, "n").agg(*[at_place(i, "v").alias(c) for c, i in (("first", F.lit(0)), ("second", F.lit(1)), ("before_last", end - 2), ("last", end - 1))])
    cut = d.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(t - 1) div {PLACES_AT_ONCE}"))))
    cut = cut.select(*by, "n", "v", (F.col("before") + F.col("b") * PLACES_AT_ONCE + 1).alias("i"), F.least("t", (F.col("b") + 1) * PLACES_AT_ONCE).alias("stop"), "before")
    cut = cut.select(*by, "n", "v", "i", (F.col("before") + F.col("stop")).alias("j")).repartition(F.xxhash64(*by, "i"))  # a value of very many rows spreads
    scored = cut.withColumn("m", normal_score_sums("n", "i", "j"))
    mean = rows.groupBy(*by).agg(F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("ss"))
    scored = join_keys(scored, mean.select(*by, "mean"), by)
    sums = scored.groupBy(*by).agg(F.sum("m.square").alias("mm"), F.sum(F.col("m.plain") * (F.col("v") - F.col("mean"))).alias("mx"))
    got = join_keys(join_keys(sums, ends, by), mean.select(*by, "ss"), by)
    at = lambda i: normal_score((F.greatest(i, F.lit(1)) - 0.375) / (end + 0.25))
    got = got.withColumn("m_before", at(end - 1)).withColumn("m_last", at(end))
    w = shapiro_w(*[F.col(c) for c in ("n", "mm", "mx", "ss", "first", "second", "before_last", "last", "m_before", "m_last")])
    got = got.withColumn("statistic", w).withColumn("p", shapiro_p("statistic", "n"))
    return got.select(*by, "n", "statistic", "p", F.coalesce(F.col("p") > 0.05, F.lit(False)).alias("is_normal"))


def omnibus_select(df: DataFrame, keys: list[str], group: str, value: str, normality: str = "shapiro", least: int = 3) -> DataFrame:
    """The test that suits each key: all groups normal and variances alike: ANOVA; normal alone: Alexander-Govern
    (often called Welch's ANOVA); else Kruskal-Wallis. Keys with a group under ``least`` values are left out."""
    norm = (shapiro_wilk if normality == "shapiro" else jarque_bera)(df, keys, group, value)
    norm = norm.groupBy(*keys).agg(F.min("n").alias("least"), F.bool_and("is_normal").alias("all_normal")).filter(F.col("least") >= least).drop("least")
    lev = levene(df, keys, group, value).select(*keys, (F.coalesce(F.col("p"), F.lit(0.0)) > 0.05).alias("is_homogeneous"))
    part = lambda d, x: d.select(*keys, *[F.col(c).alias(f"{x}_{c}") for c in ("statistic", "effect_size", "p")])
    got = reduce(
        lambda a, b: a.join(b, keys),
        [norm, lev, part(anova_oneway(df, keys, group, value), "a"), part(alexander_govern(df, keys, group, value), "w"), part(kruskal_wallis(df, keys, group, value), "k")],
    )
    which = F.when(F.col("all_normal") & F.col("is_homogeneous"), "a").when(F.col("all_normal"), "w").otherwise("k")
    choose = lambda c: F.when(which == "a", F.col(f"a_{c}")).when(which == "w", F.col(f"w_{c}")).otherwise(F.col(f"k_{c}"))
    return got.select(
        *keys,
        F.when(which == "a", "ANOVA").when(which == "w", "Alexander-Govern").otherwise("Kruskal-Wallis").alias("test"),
        choose("statistic").alias("statistic"),
        choose("p").alias("p"),
        choose("effect_size").alias("effect_size"),
        F.when(which == "k", "epsilon2").otherwise("eta2").alias("es_name"),
        "all_normal",
        "is_homogeneous",
    )


# --- pairs of groups ------------------------------------------------------------------------------------------------


def group_pairs(m: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair of groups of a key, the smaller name first, with their moments as ``n1, mean1, var1, n2, ...``; ``m``
    has a row for each key and group."""
    a = m.select(*keys, F.col("grp").alias("g1"), *[F.col(c).alias(f"{c}1") for c in m.columns if c not in (*keys, "grp")])
    b = m.select(*keys, F.col("grp").alias("g2"), *[F.col(c).alias(f"{c}2") for c in m.columns if c not in (*keys, "grp")])
    return a.join(b, keys).filter("g1 < g2")


def cohens_d(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Standardised mean difference of every pair, by the pooled deviation; 0 where that is 0."""
    got = group_pairs(group_moments(df, keys, group, value), keys)
    return got.select(*keys, "g1", "g2", _d().alias("cohens_d"))


def _d() -> Column:
    pooled = F.sqrt(((F.col("n1") - 1) * F.coalesce("var1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("var2", F.lit(0.0))) / (F.col("n1") + F.col("n2") - 2))
    return F.when(pooled > 0, (F.col("mean1") - F.col("mean2")) / pooled).otherwise(0.0)


def tukey_hsd(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``q, df, diff, p`` of every pair, by the studentised range."""
    m = group_moments(df, keys, group, value)
    error = _between(m, keys).select(*keys, "k", (F.col("total") - F.col("k")).alias("df"), over(F.col("ssw"), F.col("total") - F.col("k")).alias("mse"))
    got = group_pairs(m, keys).join(error, keys) if keys else group_pairs(m, keys).crossJoin(F.broadcast(error))
    q = over(F.abs(F.col("mean1") - F.col("mean2")), F.sqrt(F.col("mse") / 2 * (1 / F.col("n1") + 1 / F.col("n2"))))
    return got.select(*keys, "g1", "g2", (F.col("mean1") - F.col("mean2")).alias("diff"), q.alias("q"), "k", "df").withColumn("p", range_p("q", "k", "df"))


def games_howell(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``q, df, p`` of every pair under unequal variances, with Welch's degrees of freedom."""
    m = group_moments(df, keys, group, value).withColumn("k", F.count("*").over(Window.partitionBy(*keys)))
    got = group_pairs(m, keys)
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    q = over(F.abs(F.col("mean1") - F.col("mean2")), F.sqrt((a + b) / 2))
    nu = over((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    return got.select(*keys, "g1", "g2", (F.col("mean1") - F.col("mean2")).alias("diff"), q.alias("q"), F.col("k1").alias("k"), nu.alias("df")).withColumn("p", range_p("q", "k", "df"))


def dunn_bonferroni(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``z, p`` of every pair from mean ranks, with the tie correction; p times the number of pairs, 1 at most."""
    s = rank_sums(df, keys, group, value).withColumn("rbar", F.col("r") / F.col("n")).withColumn("k", F.count("*").over(Window.partitionBy(*keys)))
    got = group_pairs(s, keys)
    n = F.col("total1").cast("double")
    se = F.sqrt((n * (n + 1) / 12 - F.col("ties1") / (12 * (n - 1))) * (1 / F.col("n1") + 1 / F.col("n2")))
    got = got.select(*keys, "g1", "g2", over(F.col("rbar1") - F.col("rbar2"), se).alias("z"), F.col("k1").alias("k"))
    return got.withColumn("p", F.least(F.lit(1.0), normal_p("z") * F.col("k") * (F.col("k") - 1) / 2)).drop("k")


def posthoc_pairs(df: DataFrame, keys: list[str], group: str, value: str, omnibus: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pairs of the keys whose omnibus test has p < ``alpha``, by the post-hoc test that goes with it; with Cohen's d."""
    hit = omnibus.filter(F.col("p") < alpha).select(*keys, "test")
    d = cohens_d(df, keys, group, value)
    parts = [
        (tukey_hsd, "ANOVA", "Tukey HSD"),
        (games_howell, "Alexander-Govern", "Games-Howell"),
        (dunn_bonferroni, "Kruskal-Wallis", "Dunn-Bonferroni"),
    ]
    got = None
    for f, test, name in parts:
        one = f(df, keys, group, value).select(*keys, "g1", "g2", "p").join(hit.filter(F.col("test") == test).select(*keys), keys, "left_semi").withColumn("posthoc", F.lit(name))
        got = one if got is None else got.unionByName(one)
    return got.join(d, [*keys, "g1", "g2"]).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def ttest_ind(df: DataFrame, keys: list[str], group: str, value: str, equal_var: bool = True) -> DataFrame:
    """``t, df, p`` of every pair of groups: Student's, or Welch's."""
    got = group_pairs(group_moments(df, keys, group, value), keys)
    n1, n2 = F.col("n1"), F.col("n2")
    a, b = F.col("var1") / n1, F.col("var2") / n2
    if equal_var:
        nu = (n1 + n2 - 2).cast("double")
        se = F.sqrt(((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / nu * (1 / n1 + 1 / n2))
    else:
        nu, se = over((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1)), F.sqrt(a + b)
    return got.select(*keys, "g1", "g2", over(F.col("mean1") - F.col("mean2"), se).alias("t"), nu.alias("df")).withColumn("p", t_p("t", "df"))


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str, g1: str, g2: str, exact_below: int = 9) -> DataFrame:
    """``u`` of the first group, ``n1, n2, p`` (two-sided): exact where a group has fewer than ``exact_below`` values
    and there are no ties, else normal with the tie and continuity corrections."""
    s = rank_sums(df.filter(F.col(group).isin([g1, g2])), keys, group, value)
    a, b = s.filter(F.col("grp") == g1), s.filter(F.col("grp") == g2).select(*keys, F.col("n").alias("n2"))
    got = (a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))).withColumnRenamed("n", "n1")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("total").cast("double")
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    got = got.withColumn("u", u)
    z = over(F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5, sd)

    @F.pandas_udf(DoubleType())
    def exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([special.mann_whitney_exact(*x) if min(x[1], x[2]) < exact_below else None for x in zip(u, n1, n2, strict=True)], dtype=float)

    small = (F.least("n1", "n2") < exact_below) & (F.col("ties") == 0)
    return got.withColumn("z", z).select(*keys, "u", F.col("n1"), F.col("n2"), "z", F.when(small, exact("u", "n1", "n2")).otherwise(F.least(F.lit(1.0), normal_p("z"))).alias("p"))


def two_group_compare(df: DataFrame, keys: list[str], group: str, value: str, g1: str, g2: str, normality: str = "jarque_bera", family: list[str] | None = None) -> DataFrame:
    """Means, deviations, the t test where both groups are normal, else Mann-Whitney, Cohen's d; ``p_fdr`` and
    ``significant`` over the rows, or within each ``family`` of them."""
    two = df.filter(F.col(group).isin([g1, g2]))
    m = group_moments(two, keys, group, value)
    pair = group_pairs(m, keys).select(*keys, *[F.col(c) for c in ("mean1", "mean2", "var1", "var2")], _d().alias("cohens_d"))
    norm = (shapiro_wilk if normality == "shapiro" else jarque_bera)(two, keys, group, value).groupBy(*keys).agg(F.bool_and("is_normal").alias("is_normal"))
    t = ttest_ind(two, keys, group, value).select(*keys, "t", F.col("p").alias("pt"))
    lo, hi = sorted([g1, g2])
    u = mann_whitney(two, keys, group, value, lo, hi).select(*keys, "u", F.col("p").alias("pu"))
    got = pair.join(norm, keys).join(t, keys).join(u, keys)
    got = got.select(
        *keys, "mean1", F.sqrt("var1").alias("std1"), "mean2", F.sqrt("var2").alias("std2"),
        F.when(F.col("is_normal"), "t-test").otherwise("Mann-Whitney").alias("test"),
        F.when(F.col("is_normal"), F.col("t")).otherwise(F.col("u")).alias("statistic"),
        F.when(F.col("is_normal"), F.col("pt")).otherwise(F.col("pu")).alias("p"), "cohens_d", "is_normal",
    )
    return fdr_bh(got, family or [], "p", order=keys)


# --- correlation and lines --------------------------------------------------------------------------------------------


def _pairs_of(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r as an aggregate over pairs without nulls; null where a side has no spread."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def pearson_corr(df: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """``n, r, p`` of complete pairs; fewer than ``least`` pairs, or a constant column, give a null r."""
    got = _pairs_of(df, x, y).groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))
    got = got.withColumn("r", F.when(F.col("n") >= least, F.nanvl("r", F.lit(None))))
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    return got.select(*keys, "n", "r", F.when(F.abs("r") >= 1, 0.0).otherwise(t_p(t, F.col("n") - 2)).alias("p"))


def spearman_corr(df: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """The same for average ranks."""
    rows = _pairs_of(df, x, y).select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    rows = average_ranks(average_ranks(rows, keys, "__x", "__rx"), keys, "__y", "__ry")
    return pearson_corr(rows, keys, "__rx", "__ry", least)


def ols_simple(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``n, slope, intercept, se, t, r2, p``: least squares of y on x. Without spread in x the line is null."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    got = _pairs_of(df, x, y).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_sxx(a, b).alias("sxx"), F.regr_syy(a, b).alias("syy"), F.regr_sxy(a, b).alias("sxy")
    )
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    got = got.withColumn("se", F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(rss / (F.col("n") - 2) / F.col("sxx")))).withColumn("t", over(F.col("slope"), F.col("se")))
    return got.select(*keys, "n", "slope", "intercept", "se", "t", over(F.col("slope") * F.col("sxy"), F.col("syy")).alias("r2")).withColumn("p", t_p("t", F.col("n") - 2))


def linear_trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return ols_simple(df, keys, x, y).select(*keys, "slope", "intercept")


# --- families of tests ------------------------------------------------------------------------------------------------


def fdr_bh(df: DataFrame, family: list[str], p: str = "p", alpha: float = 0.05, order: list[str] | None = None) -> DataFrame:
    """``p_fdr`` and ``significant`` by Benjamini and Hochberg within each family, of any size. A null p has no part and no
    result."""
    q = F.col(p) * F.col("__all") / F.col("__r")
    got = lowest_from_here(df, family, [p, *(order or [])], "__r", q, "__q", F.col(p).isNotNull())
    got = got.withColumn("p_fdr", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "__q")))
    return got.withColumn("significant", F.coalesce(F.col("p_fdr") <= alpha, F.lit(False))).drop("__all", "__r", "__q")


def f_classif(df: DataFrame, feature: str, label: str, value: str) -> DataFrame:
    """The analysis of variance of every feature by class, with ``p_fdr``, over a long table."""
    return fdr_bh(anova_oneway(df, [feature], label, value), [], "p", order=[feature])
