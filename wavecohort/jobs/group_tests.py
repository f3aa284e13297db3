"""Queries of the group summaries, tests, correlations and families of tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavecohort.jobs.base import KEYS, METRICS, metrics, query, r6, rounded, table
from wavecohort.operators import groupstats as G

CELL = f"""{METRICS},
g AS (SELECT metric, freq_band, grp, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM m GROUP BY ALL)"""

ANOVA = """z AS (
  SELECT metric, freq_band, count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS grand, sum((n - 1) * var) AS ssw FROM g GROUP BY ALL),
ab AS (
  SELECT z.metric, z.freq_band, any_value(k) AS k, any_value(z.n) AS n, any_value(ssw) AS ssw, sum(g.n * (mean - grand) * (mean - grand)) AS ssb
  FROM z JOIN g USING (metric, freq_band) GROUP BY ALL)"""

RANKS = """c AS (SELECT metric, freq_band, grp, value, count(*) AS c FROM m GROUP BY ALL),
t AS (SELECT metric, freq_band, value, sum(c) AS t FROM c GROUP BY ALL),
rk AS (SELECT *, sum(t) OVER (PARTITION BY metric, freq_band ORDER BY value) - t + (t + 1) / 2.0 AS rank FROM t),
w AS (SELECT metric, freq_band, sum(t) AS total, sum(t::DOUBLE ** 3 - t) AS ties FROM t GROUP BY ALL),
rs AS (SELECT c.metric, c.freq_band, grp, sum(c)::DOUBLE AS n, sum(c * rank)::DOUBLE AS r FROM c JOIN rk USING (metric, freq_band, value) GROUP BY ALL)"""

KRUSKAL = f"""{RANKS},
kw AS (
  SELECT metric, freq_band, count(*) AS k, any_value(total)::DOUBLE AS n,
         (12 / (any_value(total)::DOUBLE * (any_value(total) + 1)) * sum(r * r / n) - 3 * (any_value(total)::DOUBLE + 1))
         / (1 - any_value(ties) / (any_value(total)::DOUBLE ** 3 - any_value(total))) AS h
  FROM rs JOIN w USING (metric, freq_band) GROUP BY ALL)"""


@query("descriptive_stats", f"""WITH {METRICS}
SELECT metric, freq_band, grp, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM m GROUP BY ALL""")
def descriptive_stats(spark, sf_dir):
    return rounded(G.descriptive_stats(metrics(spark, sf_dir), KEYS, "grp", "value"), "mean", "std", "median", "q25", "q75", "min", "max")


@query("anova_oneway", f"""WITH {CELL}, {ANOVA}
SELECT metric, freq_band, k, n::BIGINT AS n, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic, round(ssb / (ssb + ssw), 9) AS effect_size FROM ab""")
def anova_oneway(spark, sf_dir):
    got = G.anova_oneway(metrics(spark, sf_dir), KEYS, "grp", "value").drop("p")
    return got.withColumns({"statistic": r6("statistic"), "effect_size": r6("effect_size", 9)})


@query("levene", f"""WITH {METRICS.replace("m AS", "m0 AS", 1)},
md AS (SELECT metric, freq_band, grp, median(value) AS med FROM m0 GROUP BY ALL),
m AS (SELECT m0.metric, m0.freq_band, m0.grp, abs(value - med) AS value FROM m0 JOIN md USING (metric, freq_band, grp)),
g AS (SELECT metric, freq_band, grp, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM m GROUP BY ALL), {ANOVA}
SELECT metric, freq_band, k, n::BIGINT AS n, round((ssb / (k - 1)) / (ssw / (n - k)), 5) AS statistic FROM ab""")
def levene(spark, sf_dir):
    return rounded(G.levene(metrics(spark, sf_dir), KEYS, "grp", "value").drop("p"), "statistic", digits=5)


@query("alexander_govern", f"""WITH {CELL}, {ANOVA},
x AS (SELECT *, sum(n / var * mean) OVER (PARTITION BY metric, freq_band) / sum(n / var) OVER (PARTITION BY metric, freq_band) AS mid FROM g),
y AS (SELECT metric, freq_band, n - 1.5 AS a, sqrt((n - 1.5) * ln(1 + (mean - mid) ** 2 / (var / n) / (n - 1))) AS c FROM x),
q AS (SELECT metric, freq_band, sum((c + (c ** 3 + 3 * c) / (48 * a * a) - (4 * c ** 7 + 33 * c ** 5 + 240 * c ** 3 + 855 * c) / (10 * (48 * a * a) ** 2 + 8 * (48 * a * a) * c ** 4 + 1000 * (48 * a * a))) ** 2) AS s FROM y GROUP BY ALL)
SELECT metric, freq_band, k, n::BIGINT AS n, round(ssb / (ssb + ssw), 9) AS effect_size, round(s, 6) AS statistic, round(exp(-s / 2), 6) AS p FROM ab JOIN q USING (metric, freq_band)""")
def alexander_govern(spark, sf_dir):
    got = G.alexander_govern(metrics(spark, sf_dir), KEYS, "grp", "value")
    return got.withColumns({"effect_size": r6("effect_size", 9), "statistic": r6("statistic"), "p": r6("p")})


@query("kruskal_wallis", f"""WITH {METRICS}, {KRUSKAL}
SELECT metric, freq_band, k, n::BIGINT AS n, round(h, 6) AS statistic, round((h - k + 1) / (n - k), 9) + 0.0 AS effect_size, round(exp(-h / 2), 9) AS p FROM kw""")
def kruskal_wallis(spark, sf_dir):
    got = G.kruskal_wallis(metrics(spark, sf_dir), KEYS, "grp", "value")
    return got.withColumns({"statistic": r6("statistic"), "effect_size": r6("effect_size", 9), "p": r6("p", 9)})


@query("flagship_omnibus", f"""WITH {METRICS}, {KRUSKAL},
p AS (SELECT *, exp(-h / 2) AS p FROM kw),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, metric, freq_band) AS q FROM p),
f AS (SELECT *, least(1.0, min(q) OVER (ORDER BY p DESC, metric DESC, freq_band DESC ROWS UNBOUNDED PRECEDING)) AS p_fdr FROM r)
SELECT metric, freq_band, k, n::BIGINT AS n, round(h, 6) AS statistic, round((h - k + 1) / (n - k), 9) + 0.0 AS effect_size, round(p, 9) AS p, round(p_fdr, 9) AS p_fdr, p_fdr <= 0.05 AS significant FROM f""")
def flagship_omnibus(spark, sf_dir):
    """Rank test of three groups for each metric and band, with the false discovery rate over all of them."""
    got = G.fdr_bh(G.kruskal_wallis(metrics(spark, sf_dir), KEYS, "grp", "value"), [], "p", order=KEYS)
    return got.withColumns({"statistic": r6("statistic"), "effect_size": r6("effect_size", 9), "p": r6("p", 9), "p_fdr": r6("p_fdr", 9)})


@query("jarque_bera", f"""WITH {METRICS},
a AS (SELECT metric, freq_band, grp, avg(value) AS mu FROM m GROUP BY ALL),
b AS (SELECT m.metric, m.freq_band, m.grp, count(*) AS n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM m JOIN a USING (metric, freq_band, grp) GROUP BY ALL),
c AS (SELECT metric, freq_band, grp, n, n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) AS s FROM b)
SELECT metric, freq_band, grp, n, round(s, 4) AS statistic, round(exp(-s / 2), 6) AS p, n >= 3 AND exp(-s / 2) > 0.05 AS is_normal FROM c""")
def jarque_bera(spark, sf_dir):
    got = G.jarque_bera(metrics(spark, sf_dir), KEYS, "grp", "value")
    return got.withColumns({"statistic": r6("statistic", 4), "p": r6("p")})


@query("shapiro_wilk")
def shapiro_wilk(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rounded(G.shapiro_wilk(c, ["c_nationkey"], "c_mktsegment", "c_acctbal"), "statistic", "p")


@query("omnibus_select", f"""WITH {METRICS}, {KRUSKAL}
SELECT metric, freq_band, 'Kruskal-Wallis' AS test, round(h, 6) AS statistic, round(exp(-h / 2), 9) AS p, round((h - k + 1) / (n - k), 9) + 0.0 AS effect_size, 'epsilon2' AS es_name, false AS all_normal FROM kw""")
def omnibus_select(spark, sf_dir):
    got = G.omnibus_select(metrics(spark, sf_dir), KEYS, "grp", "value", normality="jarque_bera").drop("is_homogeneous")
    return got.withColumns({"statistic": r6("statistic"), "effect_size": r6("effect_size", 9), "p": r6("p", 9)})


PAIRS = f"""{CELL},
pr AS (SELECT a.metric, a.freq_band, a.grp AS g1, b.grp AS g2, a.n AS n1, a.mean AS mean1, a.var AS var1, b.n AS n2, b.mean AS mean2, b.var AS var2
       FROM g a JOIN g b USING (metric, freq_band) WHERE a.grp < b.grp)"""


@query("cohens_d", f"""WITH {PAIRS}
SELECT metric, freq_band, g1, g2, round((mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)), 9) AS cohens_d FROM pr""")
def cohens_d(spark, sf_dir):
    return rounded(G.cohens_d(metrics(spark, sf_dir), KEYS, "grp", "value"), "cohens_d", digits=9)


@query("tukey_hsd", f"""WITH {PAIRS}, {ANOVA}
SELECT metric, freq_band, g1, g2, round(mean1 - mean2, 6) AS diff, round(abs(mean1 - mean2) / sqrt(ssw / (n - k) / 2 * (1.0 / n1 + 1.0 / n2)), 6) AS q, k, (n - k)::BIGINT AS df FROM pr JOIN ab USING (metric, freq_band)""")
def tukey_hsd(spark, sf_dir):
    return rounded(G.tukey_hsd(metrics(spark, sf_dir), KEYS, "grp", "value").drop("p"), "diff", "q")


@query("games_howell", f"""WITH {PAIRS}
SELECT metric, freq_band, g1, g2, round(mean1 - mean2, 6) AS diff, round(abs(mean1 - mean2) / sqrt((var1 / n1 + var2 / n2) / 2), 6) AS q, 3::BIGINT AS k,
       round((var1 / n1 + var2 / n2) ** 2 / ((var1 / n1) ** 2 / (n1 - 1) + (var2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM pr""")
def games_howell(spark, sf_dir):
    got = G.games_howell(metrics(spark, sf_dir), KEYS, "grp", "value").drop("p")
    return got.withColumns({"diff": r6("diff"), "q": r6("q"), "df": r6("df", 4)})


@query("dunn_bonferroni", f"""WITH {METRICS}, {RANKS}
SELECT a.metric, a.freq_band, a.grp AS g1, b.grp AS g2, round((a.r / a.n - b.r / b.n) / sqrt((total::DOUBLE * (total + 1) / 12 - ties / (12 * (total::DOUBLE - 1))) * (1 / a.n + 1 / b.n)), 6) AS z
FROM rs a JOIN rs b USING (metric, freq_band) JOIN w USING (metric, freq_band) WHERE a.grp < b.grp""")
def dunn_bonferroni(spark, sf_dir):
    return rounded(G.dunn_bonferroni(metrics(spark, sf_dir), KEYS, "grp", "value").drop("p"), "z")


@query("posthoc_pairs")
def posthoc_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice") / 1000)
    omni = G.omnibus_select(o, ["o_orderstatus"], "o_orderpriority", "price", normality="jarque_bera")
    got = G.posthoc_pairs(o, ["o_orderstatus"], "o_orderpriority", "price", omni, alpha=1.1)
    return rounded(got, "p", "cohens_d")


@query("ttest_ind", f"""WITH {PAIRS}
SELECT metric, freq_band, g1, g2, round((mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM pr""")
def ttest_ind(spark, sf_dir):
    return rounded(G.ttest_ind(metrics(spark, sf_dir), KEYS, "grp", "value").drop("p"), "t")


TWO = METRICS.replace("FROM lineitem", "FROM lineitem WHERE l_returnflag IN ('A', 'N')")


@query("mann_whitney", f"""WITH {TWO}, {RANKS},
u AS (SELECT a.metric, a.freq_band, a.r - a.n * (a.n + 1) / 2 AS u, a.n AS n1, b.n AS n2, total::DOUBLE AS n, ties FROM rs a JOIN rs b USING (metric, freq_band) JOIN w USING (metric, freq_band) WHERE a.grp = 'A' AND b.grp = 'N')
SELECT metric, freq_band, u, n1::BIGINT AS n1, n2::BIGINT AS n2, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u""")
def mann_whitney(spark, sf_dir):
    return rounded(G.mann_whitney(metrics(spark, sf_dir), KEYS, "grp", "value", "A", "N").drop("p"), "z")


@query("two_group_compare", f"""WITH {TWO}, {RANKS},
g AS (SELECT metric, freq_band, grp, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM m GROUP BY ALL)
SELECT a.metric, a.freq_band, round(a.mean, 6) AS mean1, round(sqrt(a.var), 6) AS std1, round(b.mean, 6) AS mean2, round(sqrt(b.var), 6) AS std2, 'Mann-Whitney' AS test,
       r - rs.n * (rs.n + 1) / 2 AS statistic, round((a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)), 9) AS cohens_d, false AS is_normal
FROM g a JOIN g b USING (metric, freq_band) JOIN rs ON rs.metric = a.metric AND rs.freq_band = a.freq_band AND rs.grp = 'A' WHERE a.grp = 'A' AND b.grp = 'N'""")
def two_group_compare(spark, sf_dir):
    got = G.two_group_compare(metrics(spark, sf_dir), KEYS, "grp", "value", "A", "N").drop("p", "p_fdr", "significant")
    return got.withColumns({c: r6(c) for c in ("mean1", "std1", "mean2", "std2")} | {"cohens_d": r6("cohens_d", 9)})


@query("two_group_compare_fdr")
def two_group_compare_fdr(spark, sf_dir):
    """The same tests with p-values and the false discovery rate over the rows of each band."""
    got = G.two_group_compare(metrics(spark, sf_dir), KEYS, "grp", "value", "A", "N", family=["freq_band"])
    return rounded(got.select(*KEYS, "test", "p", "p_fdr", "significant", "cohens_d"), "p", "p_fdr", "cohens_d")


@query("pearson_corr", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem GROUP BY ALL""")
def pearson_corr(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(G.pearson_corr(li, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice").drop("p"), "r", digits=9)


@query("spearman_corr", """WITH a AS (
  SELECT l_returnflag, l_linestatus, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) - 1) / 2.0 AS x,
         rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(x, y), 9) AS r FROM a GROUP BY ALL""")
def spearman_corr(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(G.spearman_corr(li, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice").drop("p"), "r", digits=9)


LINE = """l AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice / 1000, l_quantity) AS slope, regr_intercept(l_extendedprice / 1000, l_quantity) AS intercept,
  regr_sxx(l_extendedprice / 1000, l_quantity) AS sxx, regr_syy(l_extendedprice / 1000, l_quantity) AS syy, regr_sxy(l_extendedprice / 1000, l_quantity) AS sxy FROM lineitem GROUP BY ALL)"""


@query("ols_simple", f"""WITH {LINE}
SELECT l_returnflag, n, round(slope, 9) AS slope, round(intercept, 6) AS intercept, round(sqrt((syy - slope * sxy) / (n - 2) / sxx), 9) AS se, round(slope / sqrt((syy - slope * sxy) / (n - 2) / sxx), 5) AS t, round(slope * sxy / syy, 9) AS r2 FROM l""")
def ols_simple(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    got = G.ols_simple(li, ["l_returnflag"], "l_quantity", "price").drop("p")
    return got.withColumns({"slope": r6("slope", 9), "intercept": r6("intercept"), "se": r6("se", 9), "t": r6("t", 5), "r2": r6("r2", 9)})


@query("linear_trend", f"""WITH {LINE} SELECT l_returnflag, round(slope, 9) AS slope, round(intercept, 6) AS intercept FROM l""")
def linear_trend(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    return G.linear_trend(li, ["l_returnflag"], "l_quantity", "price").withColumns({"slope": r6("slope", 9), "intercept": r6("intercept")})


@query("average_rank", """SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY floor(c_acctbal / 100)) + (count(*) OVER (PARTITION BY c_mktsegment, floor(c_acctbal / 100)) - 1) / 2.0 AS rank FROM customer""")
def average_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("b", F.floor(F.col("c_acctbal") / 100))
    return G.average_ranks(c, ["c_mktsegment"], "b").select("c_custkey", "c_mktsegment", "rank")


@query("fdr_bh", """WITH t AS (SELECT p_brand AS family, p_partkey, (p_retailprice - floor(p_retailprice)) / 8 AS p FROM part),
r AS (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, p_partkey) AS q FROM t)
SELECT family, p_partkey, round(p, 9) AS p, round(least(1.0, min(q) OVER (PARTITION BY family ORDER BY p DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_fdr,
       least(1.0, min(q) OVER (PARTITION BY family ORDER BY p DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING)) <= 0.05 AS significant FROM r""")
def fdr_bh(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), "p_partkey", ((F.col("p_retailprice") - F.floor("p_retailprice")) / 8).alias("p"))
    return rounded(G.fdr_bh(part, ["family"], "p", order=["p_partkey"]), "p", "p_fdr", digits=9)


@query("f_classif", """WITH x AS (SELECT label, unnest(range(0, 64)) AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT feature, label, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM x GROUP BY ALL),
z AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS grand, sum((n - 1) * coalesce(var, 0)) AS ssw FROM g GROUP BY ALL)
SELECT feature::INTEGER AS feature, round((sum(g.n * (mean - grand) ** 2) / (any_value(k) - 1)) / (any_value(ssw) / (any_value(z.n) - any_value(k))), 6) AS statistic FROM z JOIN g USING (feature) GROUP BY feature""")
def f_classif(spark, sf_dir):
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("feature", "v"))
    return G.f_classif(long, "feature", "label", "v").select("feature", r6("statistic").alias("statistic"))
