"""Queries of linear models, mediation, mixed models and classification."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from wavecohort.jobs import networks as W
from wavecohort.jobs.base import query, r6, rounded, table
from wavecohort.operators import classify as C
from wavecohort.operators import groupstats as G
from wavecohort.operators import models as M
from wavecohort.operators import network as N
from wavecohort.operators import select as S

#: Resamples of a mediation, as in the studies. The SQL of the three bootstrap queries that have one states 20.
REPS = 5000


def _lines(spark, sf_dir, *more):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("m"), (F.col("l_tax") * 10 + F.col("l_extendedprice") / 50000).alias("y"), *more)


LINES = """li AS (SELECT l_returnflag, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row, l_quantity / 10 AS x, l_extendedprice / 10000 AS m, l_tax * 10 + l_extendedprice / 50000 AS y FROM lineitem)"""

EFFECTS = """ef AS (SELECT *, sxm / sxx AS a, (smy * sxx - sxy * sxm) / (sxx * smm - sxm * sxm) AS b, (sxy * smm - smy * sxm) / (sxx * smm - sxm * sxm) AS direct, sxy / sxx AS total FROM su)"""


@query("ols_multi", f"""WITH {LINES}, su AS (SELECT l_returnflag, count(*) AS n, avg(x) AS ax, avg(m) AS am, avg(y) AS ay, regr_sxx(x, x) AS sxx, regr_sxx(m, m) AS smm, regr_sxy(x, m) AS sxm, regr_sxy(x, y) AS sxy, regr_sxy(m, y) AS smy FROM li GROUP BY 1), {EFFECTS}
SELECT l_returnflag, n, unnest(['intercept', 'x', 'm']) AS term, round(unnest([ay - direct * ax - b * am, direct, b]), 6) + 0.0 AS beta FROM ef""")
def ols_multi(spark, sf_dir):
    got = M.ols_multi(_lines(spark, sf_dir), ["l_returnflag"], "y", ["x", "m"])
    return rounded(got.select("l_returnflag", "n", "term", "beta"), "beta")


MED = f"""{LINES}, c0 AS (SELECT l_returnflag, avg(x) AS x0, avg(m) AS m0, avg(y) AS y0 FROM li GROUP BY 1),
cl AS (SELECT li.l_returnflag, row, x - x0 AS x, m - m0 AS m, y - y0 AS y FROM li JOIN c0 USING (l_returnflag)),
ps AS (SELECT k, exp(-1) * sum(1 / gamma(k2 + 1)) AS p FROM range(0, 20) r(k), range(0, 20) s(k2) WHERE k2 <= k GROUP BY k),
dr AS (SELECT cl.*, rep, ('0x' || substr(md5('42|' || rep || '|' || row), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM cl, range(0, 20) q(rep)),
wd AS (SELECT l_returnflag, rep, x, m, y, (SELECT count(*) FROM ps WHERE u >= p)::DOUBLE AS w FROM dr),
su AS (SELECT l_returnflag, rep, sum(w*x*x) - sum(w*x) ** 2 / sum(w) AS sxx, sum(w*x*m) - sum(w*x) * sum(w*m) / sum(w) AS sxm, sum(w*x*y) - sum(w*x) * sum(w*y) / sum(w) AS sxy, sum(w*m*m) - sum(w*m) ** 2 / sum(w) AS smm, sum(w*m*y) - sum(w*m) * sum(w*y) / sum(w) AS smy FROM wd WHERE w > 0 GROUP BY ALL), {EFFECTS}"""


@query("bootstrap_effects", f"WITH {MED} SELECT l_returnflag, rep::INTEGER AS rep, round(a * b, 6) + 0.0 AS indirect FROM ef")
def bootstrap_effects(spark, sf_dir):
    return rounded(M.bootstrap_effects(_lines(spark, sf_dir), ["l_returnflag"], "x", "m", "y", "row", 20), "indirect")


@query("bootstrap_effects_whole")
def bootstrap_effects_whole(spark, sf_dir):
    return rounded(M.bootstrap_effects(_lines(spark, sf_dir), ["l_returnflag"], "x", "m", "y", "row", REPS, draws="stream"), "indirect")


@query("percentile_ci", f"WITH {MED} SELECT l_returnflag, round(quantile_cont(a * b, 0.025), 6) + 0.0 AS low, round(quantile_cont(a * b, 0.975), 6) + 0.0 AS high FROM ef GROUP BY 1")
def percentile_ci(spark, sf_dir):
    boot = M.bootstrap_effects(_lines(spark, sf_dir), ["l_returnflag"], "x", "m", "y", "row", 20)
    return rounded(M.percentile_ci(boot, ["l_returnflag"], "indirect"), "low", "high")


@query("percentile_ci_whole")
def percentile_ci_whole(spark, sf_dir):
    boot = M.bootstrap_effects(_lines(spark, sf_dir), ["l_returnflag"], "x", "m", "y", "row", REPS, draws="stream")
    return rounded(M.percentile_ci(boot, ["l_returnflag"], "indirect"), "low", "high")


@query("bootstrap_mediation", f"""WITH {MED}, bo AS (SELECT l_returnflag, quantile_cont(a * b, 0.025) AS low, quantile_cont(a * b, 0.975) AS high, avg((a * b <= 0)::INT) AS lo, avg((a * b >= 0)::INT) AS hi FROM ef GROUP BY 1),
s1 AS (SELECT l_returnflag, count(*) AS n, sum(x*x) AS sxx, sum(x*m) AS sxm, sum(x*y) AS sxy, sum(m*m) AS smm, sum(m*y) AS smy FROM cl GROUP BY 1),
e1 AS (SELECT *, sxm / sxx AS a, (smy * sxx - sxy * sxm) / (sxx * smm - sxm * sxm) AS b, (sxy * smm - smy * sxm) / (sxx * smm - sxm * sxm) AS direct, sxy / sxx AS total FROM s1)
SELECT l_returnflag, n, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(direct, 6) + 0.0 AS direct, round(total, 6) + 0.0 AS total, round(a * b, 6) + 0.0 AS indirect, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(least(1.0, 2 * CASE WHEN a * b >= 0 THEN lo ELSE hi END), 6) AS p, round(abs(a * b / total), 5) AS proportion FROM e1 JOIN bo USING (l_returnflag)""")
def bootstrap_mediation(spark, sf_dir):
    got = M.bootstrap_mediation(_lines(spark, sf_dir), ["l_returnflag"], "x", "m", "y", "row", 20)
    return got.withColumns({c: r6(c) for c in ("a", "b", "direct", "total", "indirect", "low", "high", "p")} | {"proportion": r6("proportion", 5)})


@query("bootstrap_mediation_whole")
def bootstrap_mediation_whole(spark, sf_dir):
    got = M.bootstrap_mediation(_lines(spark, sf_dir), ["l_returnflag"], "x", "m", "y", "row", REPS, draws="stream")
    return got.withColumns({c: r6(c) for c in ("a", "b", "direct", "total", "indirect", "low", "high", "p")} | {"proportion": r6("proportion", 5)})


@query("simple_mediation_sobel", f"""WITH {LINES}, o AS (SELECT l_returnflag, regr_slope(m, x) AS a, sqrt((regr_syy(m, x) - regr_slope(m, x) * regr_sxy(m, x)) / (count(*) - 2) / regr_sxx(m, x)) AS sa,
  regr_slope(y, m) AS b, sqrt((regr_syy(y, m) - regr_slope(y, m) * regr_sxy(y, m)) / (count(*) - 2) / regr_sxx(y, m)) AS sb, regr_slope(y, x) AS c FROM li GROUP BY 1)
SELECT l_returnflag, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, round(a * b, 6) + 0.0 AS indirect, round(sqrt((a * sb) ** 2 + (b * sa) ** 2), 6) AS se, round(a * b / sqrt((a * sb) ** 2 + (b * sa) ** 2), 4) + 0.0 AS z FROM o""")
def simple_mediation_sobel(spark, sf_dir):
    got = M.sobel_mediation(_lines(spark, sf_dir), ["l_returnflag"], "x", "m", "y").drop("p", "percent")
    return got.withColumns({c: r6(c) for c in ("a", "b", "c", "indirect", "se")} | {"z": r6("z", 4)})


@query("batch_mediation")
def batch_mediation(spark, sf_dir):
    li = _lines(spark, sf_dir, (F.col("l_discount") * 10).alias("c")).withColumn("z", F.col("m") - F.col("x"))
    got = M.batch_mediation(li, "x", ["m", "z"], ["y"], "row", REPS, draws="stream", covariates=["c"])
    return rounded(got, "indirect", "low", "high", "p", "p_fdr").select("mediator", "outcome", "n", "indirect", "low", "high", "p", "p_fdr", "significant")


BATCH = " ".join(f"s_{p}{q} - s_{p}c * s_{q}c / s_cc AS p_{p}{q}," for p, q in ("xx", "xm", "xy", "mm", "my", "yy"))


@query("batch_mediation_effects", f"""WITH l0 AS (SELECT l_quantity / 10 AS x, l_extendedprice / 10000 AS m, l_tax * 10 + l_extendedprice / 50000 AS y, l_discount * 10 AS c FROM lineitem),
li AS (SELECT 'm' AS mediator, x, m, y, c FROM l0 UNION ALL SELECT 'z', x, m - x, y, c FROM l0),
su AS (SELECT mediator, count(*) AS n, regr_sxx(x, x) AS s_xx, regr_sxy(x, m) AS s_xm, regr_sxy(x, y) AS s_xy, regr_sxy(x, c) AS s_xc, regr_sxx(m, m) AS s_mm, regr_sxy(m, y) AS s_my, regr_sxy(m, c) AS s_mc, regr_sxx(y, y) AS s_yy, regr_sxy(y, c) AS s_yc, regr_sxx(c, c) AS s_cc FROM li GROUP BY 1),
pa AS (SELECT mediator, {BATCH} n FROM su)
SELECT mediator, 'y' AS outcome, n, round(p_xm / p_xx, 6) + 0.0 AS a, round((p_my * p_xx - p_xy * p_xm) / (p_xx * p_mm - p_xm * p_xm), 6) + 0.0 AS b, round((p_xy * p_mm - p_my * p_xm) / (p_xx * p_mm - p_xm * p_xm), 6) + 0.0 AS direct, round(p_xy / p_xx, 6) + 0.0 AS total FROM pa""")
def batch_mediation_effects(spark, sf_dir):
    """The effects on the sample, covariates in every equation; a few resamples, which the SQL does not state."""
    li = _lines(spark, sf_dir, (F.col("l_discount") * 10).alias("c")).withColumn("z", F.col("m") - F.col("x"))
    got = M.batch_mediation(li, "x", ["m", "z"], ["y"], "row", 10, covariates=["c"])
    return rounded(got.select("mediator", "outcome", "n", "a", "b", "direct", "total"), "a", "b", "direct", "total")


def _component_mediation(spark, sf_dir):
    """Components of every band and pair of groups, each among the subjects of its pair."""
    means = N.component_mean(W.edges(spark, sf_dir), W._components(spark, sf_dir), W.BY)
    emb = table(spark, sf_dir, "embeddings")
    groups = emb.select(F.col("vec_id").alias("subject_id"), F.concat(F.lit("g"), (F.col("label") % 3).cast("string")).alias("grp"))
    means = means.join(groups, "subject_id").filter((F.col("grp") == F.col("g1")) | (F.col("grp") == F.col("g2"))).drop("grp")
    out = emb.select(F.col("vec_id").alias("subject_id"), F.col("embedding")[40].cast("double").alias("reading"), F.col("embedding")[41].cast("double").alias("naming"), F.col("embedding")[42].cast("double").alias("age"))
    return M.component_mediation(means, out, "subject_id", [*W.BY, "component"], groups, F.col("g1"), ["reading", "naming"], REPS, covariates=["age"])


@query("component_mediation")
def component_mediation(spark, sf_dir):
    return rounded(_component_mediation(spark, sf_dir), "indirect", "low", "high", "p", "p_fdr").select(*W.BY, "component", "outcome", "n", "indirect", "low", "high", "p", "p_fdr", "significant")


@query("mediation_summary")
def mediation_summary(spark, sf_dir):
    """Tidy rows of all mediators, with discount as a covariate."""
    li = _covered(spark, sf_dir)
    got = M.mediation_table(li, ["l_returnflag", "l_linestatus"], "x", "m", "y", "row", REPS, draws="stream", covariates=["c"])
    return rounded(got, "a", "a_p", "b", "b_p", "total", "total_p", "direct", "direct_p", "indirect", "low", "high", "p", "proportion", "p_fdr", digits=5)


@query("mediation_counts")
def mediation_counts(spark, sf_dir):
    got = _component_mediation(spark, sf_dir).groupBy("freq_band", "g1", "g2", "outcome").agg(F.count("*").alias("n_models"), F.count_if("significant").alias("n_significant"), F.min("p_fdr").alias("least_p"))
    return rounded(got, "least_p")


def _covered(spark, sf_dir):
    return _lines(spark, sf_dir, F.col("l_linestatus"), (F.col("l_discount") * 10).alias("c"))


PARTIAL = " ".join(f"s_{p}{q} - s_{p}c * s_{q}c / s_cc AS p_{p}{q}," for p, q in ("xx", "xm", "xy", "mm", "my", "yy"))


@query("mediation_paths", f"""WITH li AS (SELECT l_returnflag, l_linestatus, l_quantity / 10 AS x, l_extendedprice / 10000 AS m, l_tax * 10 + l_extendedprice / 50000 AS y, l_discount * 10 AS c FROM lineitem),
su AS (SELECT l_returnflag, l_linestatus, count(*) AS n, regr_sxx(x, x) AS s_xx, regr_sxy(x, m) AS s_xm, regr_sxy(x, y) AS s_xy, regr_sxy(x, c) AS s_xc, regr_sxx(m, m) AS s_mm, regr_sxy(m, y) AS s_my, regr_sxy(m, c) AS s_mc, regr_sxx(y, y) AS s_yy, regr_sxy(y, c) AS s_yc, regr_sxx(c, c) AS s_cc FROM li GROUP BY 1, 2),
pa AS (SELECT l_returnflag, l_linestatus, {PARTIAL} n FROM su),
ef AS (SELECT *, p_xm / p_xx AS a, (p_my * p_xx - p_xy * p_xm) / (p_xx * p_mm - p_xm * p_xm) AS b, (p_xy * p_mm - p_my * p_xm) / (p_xx * p_mm - p_xm * p_xm) AS direct, p_xy / p_xx AS total FROM pa)
SELECT l_returnflag, l_linestatus, n, round(a, 6) + 0.0 AS a, round(sqrt((p_mm - a * p_xm) / (n - 3) / p_xx), 6) AS a_se, round(b, 6) + 0.0 AS b, round(sqrt((p_yy - direct * p_xy - b * p_my) / (n - 4) * p_xx / (p_xx * p_mm - p_xm * p_xm)), 6) AS b_se,
  round(direct, 6) + 0.0 AS direct, round(sqrt((p_yy - direct * p_xy - b * p_my) / (n - 4) * p_mm / (p_xx * p_mm - p_xm * p_xm)), 6) AS direct_se, round(total, 6) + 0.0 AS total, round(sqrt((p_yy - total * p_xy) / (n - 3) / p_xx), 6) AS total_se FROM ef""")
def mediation_paths(spark, sf_dir):
    """Paths with a covariate, their standard errors; p-values follow from both and are held by unit tests."""
    got = M.mediation_paths(_covered(spark, sf_dir), ["l_returnflag", "l_linestatus"], "x", "m", "y", ["c"])
    return rounded(got.drop("a_p", "b_p", "direct_p", "total_p"), "a", "a_se", "b", "b_se", "direct", "direct_se", "total", "total_se")


def _prices(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("subject_id"), F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")).alias("grp"), F.col("l_linestatus").alias("band"), F.log10(F.col("l_extendedprice") + 1e-20).alias("y"), F.col("l_quantity").alias("age"))


MIX = "li AS (SELECT l_suppkey AS subject_id, 'g' || (l_suppkey % 3) AS grp, l_linestatus AS band, log10(l_extendedprice + 1e-20) AS y FROM lineitem)"


@query("mixed_model_random_intercept")
def mixed_model_random_intercept(spark, sf_dir):
    got = M.mixed_model(_prices(spark, sf_dir), ["band"], "subject_id", "y", "grp", "g0", ["g0", "g1", "g2"])
    return rounded(got.select("band", "term", "beta", "se", "z", "p", "icc", "n", "n_subjects"), "beta", "se", "z", "p", "icc", digits=4)


@query("fixed_effect_summary")
def fixed_effect_summary(spark, sf_dir):
    got = M.mixed_model(_prices(spark, sf_dir), ["band"], "subject_id", "y", "grp", "g0", ["g0", "g1", "g2"]).filter("term <> 'Intercept'")
    return rounded(got.select("band", F.col("term").alias("comparison"), "beta", "low", "high", "p"), "beta", "low", "high", "p", digits=4)


@query("age_adjusted_group_test")
def age_adjusted_group_test(spark, sf_dir):
    rows = _prices(spark, sf_dir).withColumn("age2", F.col("age") * F.col("age") / 100)
    one = M.mixed_model(rows, ["band"], "subject_id", "y", "grp", "g0", ["g0", "g1", "g2"], ["age"]).withColumn("model", F.lit("linear"))
    two = M.mixed_model(rows, ["band"], "subject_id", "y", "grp", "g0", ["g0", "g1", "g2"], ["age", "age2"]).withColumn("model", F.lit("square"))
    by_group = rows.withColumns({f"{g} x age": F.when(F.col("grp") == g, F.col("age")).otherwise(0.0) for g in ("g1", "g2")})
    three = M.mixed_model(by_group, ["band"], "subject_id", "y", "grp", "g0", ["g0", "g1", "g2"], ["age", "g1 x age", "g2 x age"]).withColumn("model", F.lit("group x age"))
    return rounded(one.unionByName(two).unionByName(three).select("band", "model", "term", "beta", "p", "aic", "bic"), "beta", "p", "aic", "bic", digits=3)


@query("age_adjusted_contrasts")
def age_adjusted_contrasts(spark, sf_dir):
    """Differences of the groups at the mean age, age alone and with a slope for each group."""
    rows = _prices(spark, sf_dir)
    one = M.adjusted_contrasts(rows, ["band"], "subject_id", "y", "grp", ["g0", "g1", "g2"], ["age"]).withColumn("model", F.lit("linear"))
    two = M.adjusted_contrasts(rows, ["band"], "subject_id", "y", "grp", ["g0", "g1", "g2"], ["age"], ["age"]).withColumn("model", F.lit("group x age"))
    return rounded(one.unionByName(two), "mean1", "mean2", "diff", "se", "z", "p", "p_adjusted", "low", "high", digits=4)


ICC = f"""{MIX}, p AS (SELECT band, subject_id, count(*) AS n, avg(y) AS m, coalesce(var_samp(y), 0) AS v FROM li GROUP BY ALL),
s AS (SELECT band, count(*) AS k, sum(n) AS t, sum(n * n) AS n2, sum((n - 1) * v) AS ssw, sum(n * m) / sum(n) AS g FROM p GROUP BY 1),
b AS (SELECT p.band, sum(n * (m - g) ** 2) AS ssb FROM p JOIN s USING (band) GROUP BY 1),
vc AS (SELECT band, g, ssw / (t - k) AS vw, greatest(0.0, (ssb / (k - 1) - ssw / (t - k)) / ((t - n2 / t) / (k - 1))) AS vb FROM s JOIN b USING (band))"""


@query("icc", f"WITH {ICC} SELECT band, round(vb, 9) AS var_between, round(vw, 9) AS var_within, round(vb / (vb + vw), 9) AS icc FROM vc")
def icc(spark, sf_dir):
    return rounded(M.icc_anova(_prices(spark, sf_dir), ["band"], "subject_id", "y"), "var_between", "var_within", "icc", digits=9)


@query("residual_diagnostics", f"""WITH {ICC}, r AS (SELECT li.band, y - (g + CASE WHEN vb > 0 THEN vb / (vb + vw / n) ELSE 0 END * (m - g)) AS residual FROM li JOIN p USING (band, subject_id) JOIN vc USING (band))
SELECT band, count(*) AS n, round(avg(residual), 6) + 0.0 AS mean, round(stddev_samp(residual), 6) AS sd, round(quantile_cont(residual, 0.05), 5) + 0.0 AS q05, round(quantile_cont(residual, 0.95), 5) + 0.0 AS q95 FROM r GROUP BY 1""")
def residual_diagnostics(spark, sf_dir):
    r = M.residuals(_prices(spark, sf_dir), ["band"], "subject_id", "y")
    got = M.residual_summary(r, ["band"], "residual", {"q05": 0.05, "q95": 0.95})
    return got.select("band", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("q05", 5).alias("q05"), r6("q95", 5).alias("q95"))


#: Probabilities of the Q-Q points.
POINTS = [i / 20 for i in range(1, 20)]


@query("residual_qq", f"""WITH {ICC}, r AS (SELECT li.band, y - (g + CASE WHEN vb > 0 THEN vb / (vb + vw / n) ELSE 0 END * (m - g)) AS residual FROM li JOIN p USING (band, subject_id) JOIN vc USING (band)),
q AS (SELECT band, unnest({POINTS}) AS p, unnest({[round(NormalDist().inv_cdf(p), 5) + 0.0 for p in POINTS]}) AS normal, unnest(quantile_cont(residual, {POINTS})) AS sample FROM r GROUP BY band)
SELECT band, p::DOUBLE AS p, normal::DOUBLE AS normal, round(sample, 5) + 0.0 AS sample FROM q""")
def residual_qq(spark, sf_dir):
    got = M.qq_points(M.residuals(_prices(spark, sf_dir), ["band"], "subject_id", "y"), ["band"], "residual")
    return got.select("band", "p", r6("normal", 5).alias("normal"), r6("sample", 5).alias("sample"))


@query("within_subject_sd", f"WITH {MIX} SELECT band, subject_id, grp, round(stddev_samp(y), 9) AS sd FROM li GROUP BY ALL HAVING count(*) > 1")
def within_subject_sd(spark, sf_dir):
    return rounded(M.within_subject_sd(_prices(spark, sf_dir), ["band"], "subject_id", "grp", "y"), "sd", digits=9)


@query("order_by_p", "SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS r, row_number() OVER (ORDER BY abs(corr(l_quantity, l_extendedprice)) DESC, l_suppkey)::INTEGER AS place FROM lineitem GROUP BY 1 QUALIFY place <= 20")
def order_by_p(spark, sf_dir):
    got = G.pearson_corr(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 2)
    top = S.top_per_group(got, [], 20, F.abs("r").desc(), "l_suppkey")
    return top.select("l_suppkey", r6("r").alias("r"), F.col("rank").alias("place"))


@query("top_features", """WITH x AS (SELECT label, unnest(range(0, 64)) AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT feature, label, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM x GROUP BY ALL),
z AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS grand, sum((n - 1) * coalesce(var, 0)) AS ssw FROM g GROUP BY ALL),
f AS (SELECT feature, (sum(g.n * (mean - grand) ** 2) / (any_value(k) - 1)) / (any_value(ssw) / (any_value(z.n) - any_value(k))) AS s FROM z JOIN g USING (feature) GROUP BY feature)
SELECT feature::INTEGER AS feature, round(s, 6) AS statistic, row_number() OVER (ORDER BY s DESC, feature)::INTEGER AS rank FROM f QUALIFY rank <= 15""")
def top_features(spark, sf_dir):
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("feature", "v"))
    f = G.anova_oneway(long, ["feature"], "label", "v").select("feature", "statistic")
    return S.top_per_group(f, [], 15, F.desc("statistic"), "feature").withColumn("statistic", r6("statistic"))


def _classes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return S.stratified_folds(e, "y", "vec_id", 5)


@query("pca_features")
def pca_features(spark, sf_dir):
    got, shares = C.pca_scores(_classes(spark, sf_dir), "x", 3)
    s = got.agg(*[F.abs(F.stddev_samp(F.col("scores")[i])).alias(f"sd{i}") for i in range(3)])
    return s.select(*[r6(f"sd{i}", 4).alias(f"sd{i}") for i in range(3)], *[F.lit(round(v, 4)).alias(f"share{i}") for i, v in enumerate(shares)])


@query("cv_classify")
def cv_classify(spark, sf_dir):
    return C.cv_classify(_classes(spark, sf_dir), "x", "y", "fold", 5, "logistic", k=10).select("vec_id", "fold", "y", "predicted")


GUESS = "gs AS (SELECT vec_id, label % 2 AS y, ((row_number() OVER (PARTITION BY label % 2 ORDER BY md5('42|' || vec_id), vec_id) - 1) % 5) AS fold, (embedding[1] > 0)::INTEGER AS guess FROM embeddings)"


def _guess(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), (F.col("embedding")[0] > 0).cast("int").alias("guess"))
    return S.stratified_folds(e, "y", "vec_id", 5)


@query("confusion_matrix", f"WITH {GUESS} SELECT y AS truth, guess, count(*) AS n FROM gs GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return C.confusion_matrix(_guess(spark, sf_dir), "y", "guess")


@query("accuracy_balanced", f"""WITH {GUESS}, a AS (SELECT fold, y, avg((y = guess)::INT) AS rec, count(*) AS n, sum((y = guess)::INT) AS h FROM gs GROUP BY ALL), f AS (SELECT fold, sum(h) / sum(n) AS acc, avg(rec) AS bal FROM a GROUP BY 1)
SELECT round(avg(acc), 9) AS accuracy, round(stddev_pop(acc), 9) AS accuracy_sd, round(avg(bal), 9) AS balanced, round(stddev_pop(bal), 9) AS balanced_sd FROM f""")
def accuracy_balanced(spark, sf_dir):
    return rounded(C.accuracies(_guess(spark, sf_dir), "y", "guess", "fold"), "accuracy", "accuracy_sd", "balanced", "balanced_sd", digits=9)


#: Shuffles of the labels, as in the studies.
SHUFFLES = 2000


@query("permutation_accuracy")
def permutation_accuracy(spark, sf_dir):
    null = C.permutation_accuracy(_classes(spark, sf_dir), "x", "y", "fold", "vec_id", SHUFFLES)
    return rounded(C.permutation_p(null), "accuracy", "balanced", "p", "p_balanced")


@query("spatial_component_test")
def spatial_component_test(spark, sf_dir):
    """Channel patterns reduced to components, each tested by the mixed model across subjects."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 60).alias("subject_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    scores, _ = C.pca_scores(e, "x", 2)
    long = scores.select("subject_id", F.concat(F.lit("g"), (F.col("subject_id") % 3).cast("string")).alias("grp"), F.posexplode("scores").alias("component", "y"))
    got = M.mixed_model(long, ["component"], "subject_id", "y", "grp", "g0", ["g0", "g1", "g2"]).filter("term <> 'Intercept'")
    return rounded(got.select("component", "term", F.abs("z").alias("z"), "p"), "z", "p", digits=4)


#: Neighbours of the montage of eight channels in a row.
NEAR = [(f"n{i}", f"n{i + 1}") for i in range(7)]


def _clusters(spark, sf_dir):
    """Each channel's sum of edge weights, in all bands and pairs of groups."""
    e = W.edges(spark, sf_dir)
    per = e.select("subject_id", "grp", "freq_band", F.explode(F.array("ch1", "ch2")).alias("channel"), "weight").groupBy("subject_id", "grp", "freq_band", "channel").agg(F.sum("weight").alias("value"))
    return N.cluster_permutation(per, ["freq_band"], W.PAIRS, NEAR, 0.3, W.PERMS)


@query("cluster_permutation_channels", f"""WITH RECURSIVE {W.EDGES}, dg AS (SELECT subject_id, grp, freq_band, x AS channel, sum(weight) AS w FROM (SELECT subject_id, grp, freq_band, unnest([ch1, ch2]) AS x, weight FROM ed) GROUP BY ALL),
mo AS (SELECT freq_band, channel, grp, count(*) AS n, avg(w) AS m, var_samp(w) AS v FROM dg GROUP BY ALL),
tt AS (SELECT a.freq_band, a.grp AS g1, b.grp AS g2, a.channel, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t FROM mo a JOIN mo b USING (freq_band, channel) WHERE a.grp < b.grp),
hi AS (SELECT *, CASE WHEN t > 0 THEN 'positive' ELSE 'negative' END AS direction FROM tt WHERE abs(t) > 0.3),
ad AS (SELECT 'n' || i AS a, 'n' || (i + 1) AS b FROM range(0, 7) r(i)),
li AS (SELECT x.freq_band, x.g1, x.g2, x.direction, a, b FROM ad JOIN hi x ON x.channel = a JOIN hi y ON y.channel = b AND y.freq_band = x.freq_band AND y.g1 = x.g1 AND y.g2 = x.g2 AND y.direction = x.direction),
nb AS (SELECT * FROM li UNION ALL SELECT freq_band, g1, g2, direction, b, a FROM li),
re AS (SELECT freq_band, g1, g2, direction, channel AS a, channel AS r FROM hi UNION SELECT nb.freq_band, nb.g1, nb.g2, nb.direction, nb.b, re.r FROM re JOIN nb ON nb.a = re.a AND nb.freq_band = re.freq_band AND nb.g1 = re.g1 AND nb.g2 = re.g2 AND nb.direction = re.direction)
SELECT re.freq_band, re.g1, re.g2, re.direction, a AS channel, min(r) AS cluster, round(any_value(t), 6) AS t FROM re JOIN hi ON hi.channel = a AND hi.freq_band = re.freq_band AND hi.g1 = re.g1 AND hi.g2 = re.g2 AND hi.direction = re.direction GROUP BY ALL""")
def cluster_permutation_channels(spark, sf_dir):
    """Neighbouring channels that differ between two groups in the same direction, as clusters: the observed ones."""
    e = W.edges(spark, sf_dir)
    per = e.select("subject_id", "grp", "freq_band", F.explode(F.array("ch1", "ch2")).alias("channel"), "weight").groupBy("subject_id", "grp", "freq_band", "channel").agg(F.sum("weight").alias("w"))
    by = ["freq_band", "channel"]
    pair = G.group_pairs(G.group_moments(per, by, "grp", "w"), by)
    t = pair.select("freq_band", "g1", "g2", "channel", N.welch_t(*[F.col(c) for c in ("mean1", "mean2", "var1", "var2", "n1", "n2")]).alias("t"))
    return rounded(N.channel_clusters(t, ["freq_band", "g1", "g2"], spark.createDataFrame(NEAR, "a string, b string"), 0.3), "t")


@query("cluster_permutation_test")
def cluster_permutation_test(spark, sf_dir):
    """Their masses against the largest of each permutation."""
    stats, _ = _clusters(spark, sf_dir)
    return rounded(stats, "mass", "p_value")
