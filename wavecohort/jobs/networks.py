"""Queries of networks: tests on edges, components, permutations, regions and graph metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavecohort.jobs.base import query, r6, rounded, table
from wavecohort.operators import network as N

EDGES = """ed AS (
  SELECT vec_id AS subject_id, 'g' || (label % 3) AS grp, freq_band, 'n' || i AS ch1, 'n' || j AS ch2,
         100 * embedding[o + i + 1]::DOUBLE * embedding[o + j + 1]::DOUBLE AS weight
  FROM embeddings, (VALUES ('b0', 0), ('b1', 8)) b(freq_band, o), range(0, 8) x(i), range(0, 8) y(j) WHERE i < j)"""
POSITIVE = EDGES.replace("100 * embedding[o + i + 1]::DOUBLE * embedding[o + j + 1]::DOUBLE", "abs(100 * embedding[o + i + 1]::DOUBLE * embedding[o + j + 1]::DOUBLE)")

T = f"""{EDGES},
mo AS (SELECT freq_band, ch1, ch2, grp, count(*) AS n, avg(weight) AS m, var_samp(weight) AS v FROM ed GROUP BY ALL),
t AS (SELECT a.freq_band, a.ch1, a.ch2, a.grp AS g1, b.grp AS g2, CASE WHEN a.v / a.n + b.v / b.n > 0 THEN (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) ELSE 0 END AS t
      FROM mo a JOIN mo b USING (freq_band, ch1, ch2) WHERE a.grp < b.grp)"""

COMP = f"""WITH RECURSIVE {T},
su AS (SELECT *, CASE WHEN t > 0 THEN 'positive' ELSE 'negative' END AS direction FROM t WHERE abs(t) > 1.0),
nb AS (SELECT freq_band, g1, g2, direction, ch1 AS a, ch2 AS b FROM su UNION ALL SELECT freq_band, g1, g2, direction, ch2, ch1 FROM su),
re AS (SELECT DISTINCT freq_band, g1, g2, direction, a, a AS r FROM nb UNION SELECT nb.freq_band, nb.g1, nb.g2, nb.direction, nb.b, re.r FROM re JOIN nb ON nb.freq_band = re.freq_band AND nb.g1 = re.g1 AND nb.g2 = re.g2 AND nb.direction = re.direction AND nb.a = re.a),
co AS (SELECT freq_band, g1, g2, direction, a, min(r) AS component FROM re GROUP BY ALL),
ec AS (SELECT su.*, component FROM su JOIN co ON co.freq_band = su.freq_band AND co.g1 = su.g1 AND co.g2 = su.g2 AND co.direction = su.direction AND co.a = su.ch1),
st AS (SELECT freq_band, g1, g2, direction, component, count(*) AS n_edges, sum(abs(t)) AS intensity FROM ec GROUP BY ALL),
nn AS (SELECT freq_band, g1, g2, direction, component, count(DISTINCT x) AS n_nodes FROM (SELECT freq_band, g1, g2, direction, component, unnest([ch1, ch2]) AS x FROM ec) GROUP BY ALL)"""

PAIRS = [("g0", "g1"), ("g0", "g2"), ("g1", "g2")]
BY = ["freq_band", "g1", "g2", "direction"]
#: Permutations of a test, as in the studies. The SQL of nbs_permutation_test and nbs_summary states 6 of one pair.
PERMS = 3000


def edges(spark, sf_dir, absolute=False):
    e = table(spark, sf_dir, "embeddings")
    cells = [F.struct(F.lit(b).alias("freq_band"), F.lit(f"n{i}").alias("ch1"), F.lit(f"n{j}").alias("ch2"), (100 * F.col("embedding")[o + i].cast("double") * F.col("embedding")[o + j].cast("double")).alias("weight")) for b, o in (("b0", 0), ("b1", 8)) for i in range(8) for j in range(i + 1, 8)]
    got = e.select(F.col("vec_id").alias("subject_id"), F.concat(F.lit("g"), (F.col("label") % 3).cast("string")).alias("grp"), F.explode(F.array(*cells)).alias("c")).select("subject_id", "grp", "c.*")
    return got.withColumn("weight", F.abs("weight")) if absolute else got


def _t(spark, sf_dir):
    return N.welch_t_edges(edges(spark, sf_dir), ["freq_band"])


def _components(spark, sf_dir):
    return N.edge_components(N.threshold_edges(_t(spark, sf_dir), 1.0), BY)


def _regions(spark):
    return spark.createDataFrame([(f"n{i}", "front" if i < 3 else "back") for i in range(6)], "channel string, region string")


REGIONS = "rg(channel, region) AS (VALUES ('n0', 'front'), ('n1', 'front'), ('n2', 'front'), ('n3', 'back'), ('n4', 'back'), ('n5', 'back'))"
ROIS = "ro(roi, channel) AS (VALUES ('A', 'n0'), ('A', 'n1'), ('A', 'n2'), ('B', 'n2'), ('B', 'n3'), ('B', 'n9'))"


def _rois(spark):
    return spark.createDataFrame([("A", "n0"), ("A", "n1"), ("A", "n2"), ("B", "n2"), ("B", "n3"), ("B", "n9")], "roi string, channel string")


@query("welch_t_edges", f"WITH {T} SELECT freq_band, ch1, ch2, g1, g2, round(t, 6) + 0.0 AS t FROM t")
def welch_t_edges(spark, sf_dir):
    return rounded(_t(spark, sf_dir), "t")


@query("threshold_edges", f"WITH {T} SELECT freq_band, ch1, ch2, g1, g2, round(t, 6) AS t, 'positive' AS direction FROM t WHERE t > 1.0")
def threshold_edges(spark, sf_dir):
    return rounded(N.threshold_edges(_t(spark, sf_dir), 1.0, "positive"), "t")


@query("connected_components", f"{COMP} SELECT freq_band, g1, g2, direction, ch1, ch2, component FROM ec")
def connected_components(spark, sf_dir):
    return _components(spark, sf_dir).drop("t")


@query("component_stat", f"{COMP} SELECT freq_band, g1, g2, direction, component, n_edges, n_nodes, round(intensity, 6) AS intensity FROM st JOIN nn USING (freq_band, g1, g2, direction, component)")
def component_stat(spark, sf_dir):
    return rounded(N.component_stats(_components(spark, sf_dir), BY), "intensity")


@query("component_numbering", f"{COMP} SELECT freq_band, g1, g2, direction, component, row_number() OVER (PARTITION BY freq_band, g1, g2 ORDER BY direction DESC, component)::INTEGER AS component_id FROM st")
def component_numbering(spark, sf_dir):
    got = N.component_numbers(N.component_stats(_components(spark, sf_dir), BY), ["freq_band", "g1", "g2"])
    return got.select(*BY, "component", "component_id")


NULL = f"""{EDGES}, lb AS (
  SELECT p, subject_id, grp, row_number() OVER (PARTITION BY p ORDER BY md5('42|' || p || '|' || subject_id), subject_id::VARCHAR) <= count(*) FILTER (grp = 'g0') OVER (PARTITION BY p) AS one
  FROM (SELECT DISTINCT subject_id, grp FROM ed WHERE grp IN ('g0', 'g1')), range(0, 6) r(p)),
pm AS (SELECT p, freq_band, ch1, ch2, count(*) FILTER (one) AS n1, avg(weight) FILTER (one) AS m1, var_samp(weight) FILTER (one) AS v1, count(*) FILTER (NOT one) AS n2, avg(weight) FILTER (NOT one) AS m2, var_samp(weight) FILTER (NOT one) AS v2
       FROM ed JOIN lb USING (subject_id) GROUP BY ALL),
ps AS (SELECT p, freq_band, ch1, ch2, CASE WHEN (m1 - m2) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM pm WHERE abs((m1 - m2) / sqrt(v1 / n1 + v2 / n2)) > 1.0),
pn AS (SELECT p, freq_band, direction, ch1 AS a, ch2 AS b FROM ps UNION ALL SELECT p, freq_band, direction, ch2, ch1 FROM ps),
pr AS (SELECT DISTINCT p, freq_band, direction, a, a AS r FROM pn UNION SELECT pn.p, pn.freq_band, pn.direction, pn.b, pr.r FROM pr JOIN pn ON pn.p = pr.p AND pn.freq_band = pr.freq_band AND pn.direction = pr.direction AND pn.a = pr.a),
pc AS (SELECT p, freq_band, direction, a, min(r) AS c FROM pr GROUP BY ALL),
pz AS (SELECT ps.p, ps.freq_band, ps.direction, c, count(*) AS n FROM ps JOIN pc ON pc.p = ps.p AND pc.freq_band = ps.freq_band AND pc.direction = ps.direction AND pc.a = ps.ch1 GROUP BY ALL),
nu AS (SELECT x.p, x.freq_band, x.direction, coalesce(max(n), 0)::DOUBLE AS max_stat FROM (SELECT p, freq_band, direction FROM range(0, 6) r(p), (VALUES ('b0'), ('b1')) b(freq_band), (VALUES ('positive'), ('negative')) d(direction)) x LEFT JOIN pz USING (p, freq_band, direction) GROUP BY ALL)"""


@query("nbs_permutation_test", f"WITH RECURSIVE {NULL} SELECT freq_band, 'g0' AS g1, 'g1' AS g2, p::INTEGER AS perm, direction, max_stat FROM nu")
def nbs_permutation_test(spark, sf_dir):
    return N.null_distribution(edges(spark, sf_dir), ["freq_band"], [("g0", "g1")], 1.0, 6)


@query("nbs_permutation_test_whole")
def nbs_permutation_test_whole(spark, sf_dir):
    return N.null_distribution(edges(spark, sf_dir), ["freq_band"], PAIRS, 1.0, PERMS)


@query("nbs_all_pairs")
def nbs_all_pairs(spark, sf_dir):
    summary, _ = N.nbs(edges(spark, sf_dir), ["freq_band"], PAIRS, 1.0, PERMS)
    return rounded(summary.select(*BY, "component_id", "n_edges", "n_nodes", "stat", "p_value", "significant"), "stat", "p_value")


@query("nbs_summary", f"""{COMP.replace('RECURSIVE ' + EDGES, 'RECURSIVE ' + NULL)},
ov AS (SELECT freq_band, g1, g2, direction, component, n_edges, count(*) FILTER (max_stat >= n_edges) AS o FROM st JOIN nu USING (freq_band, direction) WHERE g1 = 'g0' AND g2 = 'g1' GROUP BY ALL)
SELECT freq_band, g1, g2, direction, row_number() OVER (PARTITION BY freq_band, g1, g2 ORDER BY direction DESC, component)::INTEGER AS component_id, n_edges, n_nodes, n_edges::DOUBLE AS stat, round((o + 1) / 7.0::DOUBLE, 6) AS p_value, false AS significant
FROM ov JOIN nn USING (freq_band, g1, g2, direction, component)
UNION ALL SELECT freq_band, 'g0', 'g1', 'none', 0, 0, 0, 0.0, 1.0, false FROM (VALUES ('b0'), ('b1'), ('b9')) z(freq_band) WHERE freq_band NOT IN (SELECT freq_band FROM ov)""")
def nbs_summary(spark, sf_dir):
    summary, _ = N.nbs(edges(spark, sf_dir), ["freq_band"], [("g0", "g1")], 1.0, 6)
    grid = spark.createDataFrame([(b, "g0", "g1") for b in ("b0", "b1", "b9")], "freq_band string, g1 string, g2 string")
    got = N.summary_with_empty(summary, grid, ["freq_band", "g1", "g2"])
    return rounded(got.select(*BY, "component_id", "n_edges", "n_nodes", "stat", "p_value", "significant"), "stat", "p_value")


@query("nbs_summary_whole")
def nbs_summary_whole(spark, sf_dir):
    summary, _ = N.nbs(edges(spark, sf_dir), ["freq_band"], PAIRS, 1.0, PERMS)
    grid = spark.createDataFrame([(b, *p) for b in ("b0", "b1", "b9") for p in PAIRS], "freq_band string, g1 string, g2 string")
    got = N.summary_with_empty(summary, grid, ["freq_band", "g1", "g2"])
    return rounded(got.select(*BY, "component_id", "n_edges", "n_nodes", "stat", "p_value", "significant"), "stat", "p_value")


@query("nbs_significant_edges")
def nbs_significant_edges(spark, sf_dir):
    _, e = N.nbs(edges(spark, sf_dir), ["freq_band"], PAIRS, 1.0, PERMS)
    return e.filter("component_p < 0.5").select(*BY, "ch1", "ch2", r6("t").alias("t"), r6("component_p").alias("component_p")).orderBy(F.abs("t").desc())


@query("significant_edges_sorted", f"WITH {T} SELECT freq_band, ch1, ch2, round(t, 6) AS t, row_number() OVER (ORDER BY abs(t) DESC, freq_band, ch1, ch2, g1, g2)::INTEGER AS place FROM t WHERE abs(t) > 1.5")
def significant_edges_sorted(spark, sf_dir):
    from pyspark.sql import Window

    got = N.threshold_edges(_t(spark, sf_dir), 1.5)  # a short list: edges beyond a high threshold
    place = F.row_number().over(Window.orderBy(F.abs("t").desc(), "freq_band", "ch1", "ch2", "g1", "g2"))
    return got.withColumn("place", place).select("freq_band", "ch1", "ch2", r6("t").alias("t"), "place")


@query("nbs_matrix", f"WITH {T}, x AS (SELECT freq_band, g1, g2, ch1, ch2, t FROM t WHERE abs(t) > 1.0) SELECT freq_band, g1, g2, ch1, ch2, round(t, 6) AS t FROM x UNION ALL SELECT freq_band, g1, g2, ch2, ch1, round(t, 6) FROM x")
def nbs_matrix(spark, sf_dir):
    return rounded(N.symmetric(N.threshold_edges(_t(spark, sf_dir), 1.0).drop("direction"), "t"), "t")


#: Thresholds to compare: the stand-ins' own and those of the studies.
THRESHOLDS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5]
CUTS = f"cu(threshold) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in THRESHOLDS)})"
SUPRA = f"""{T}, {CUTS}, su AS (SELECT freq_band, g1, g2, threshold, CASE WHEN t > 0 THEN 'positive' ELSE 'negative' END AS direction, ch1, ch2, t FROM t, cu WHERE abs(t) > threshold)"""
NET = ["freq_band", "g1", "g2"]


@query("multi_threshold_explore", f"""WITH RECURSIVE {SUPRA},
nb AS (SELECT freq_band, g1, g2, threshold, direction, ch1 AS a, ch2 AS b FROM su UNION ALL SELECT freq_band, g1, g2, threshold, direction, ch2, ch1 FROM su),
re AS (SELECT DISTINCT freq_band, g1, g2, threshold, direction, a, a AS r FROM nb UNION SELECT nb.freq_band, nb.g1, nb.g2, nb.threshold, nb.direction, nb.b, re.r FROM re JOIN nb ON nb.freq_band = re.freq_band AND nb.g1 = re.g1 AND nb.g2 = re.g2 AND nb.threshold = re.threshold AND nb.direction = re.direction AND nb.a = re.a),
co AS (SELECT freq_band, g1, g2, threshold, direction, a, min(r) AS c FROM re GROUP BY ALL),
st AS (SELECT su.freq_band, su.g1, su.g2, su.threshold, su.direction, c, count(*) AS n FROM su JOIN co ON co.freq_band = su.freq_band AND co.g1 = su.g1 AND co.g2 = su.g2 AND co.threshold = su.threshold AND co.direction = su.direction AND co.a = su.ch1 GROUP BY ALL),
gr AS (SELECT DISTINCT freq_band, g1, g2, threshold, direction FROM t, cu, (VALUES ('positive'), ('negative')) d(direction))
SELECT freq_band, g1, g2, threshold, direction, coalesce(sum(n), 0)::BIGINT AS n_supra, count(n) AS n_components, coalesce(max(n), 0)::BIGINT AS largest FROM gr LEFT JOIN st USING (freq_band, g1, g2, threshold, direction) GROUP BY ALL""")
def multi_threshold_explore(spark, sf_dir):
    return N.explore_thresholds(_t(spark, sf_dir), NET, THRESHOLDS)


@query("multi_threshold_explore_whole")
def multi_threshold_explore_whole(spark, sf_dir):
    return multi_threshold_explore(spark, sf_dir)


@query("multi_threshold_top_edges", f"""WITH {SUPRA} SELECT freq_band, g1, g2, threshold, direction, ch1, ch2, round(t, 6) AS t, row_number() OVER (PARTITION BY freq_band, g1, g2, threshold, direction ORDER BY abs(t) DESC, ch1, ch2)::INTEGER AS place FROM su QUALIFY place <= 20""")
def multi_threshold_top_edges(spark, sf_dir):
    return rounded(N.threshold_top_edges(_t(spark, sf_dir), NET, THRESHOLDS), "t")


@query("multi_threshold_regions", f"""WITH {SUPRA}, {REGIONS}, x AS (SELECT freq_band, g1, g2, threshold, direction, coalesce(region, 'Other') AS region, count(*) AS n_edges FROM (SELECT freq_band, g1, g2, threshold, direction, unnest([ch1, ch2]) AS channel FROM su) LEFT JOIN rg USING (channel) GROUP BY ALL)
SELECT *, round(n_edges / sum(n_edges) OVER (PARTITION BY freq_band, g1, g2, threshold, direction) * 100, 6) AS pct FROM x""")
def multi_threshold_regions(spark, sf_dir):
    return rounded(N.threshold_regions(_t(spark, sf_dir), NET, THRESHOLDS, _regions(spark)), "pct")


@query("edge_feature_matrix", f"""WITH {EDGES} SELECT subject_id, round(any_value(weight) FILTER (ch1 = 'n0' AND ch2 = 'n1'), 6) + 0.0 AS "n0-n1", round(any_value(weight) FILTER (ch1 = 'n2' AND ch2 = 'n5'), 6) + 0.0 AS "n2-n5", 0.0::DOUBLE AS "n8-n9" FROM ed WHERE freq_band = 'b0' GROUP BY 1""")
def edge_feature_matrix(spark, sf_dir):
    e = edges(spark, sf_dir).filter("freq_band = 'b0'")
    names = ["n0-n1", "n2-n5", "n8-n9"]
    got = N.edge_features(e, "subject_id", names)
    return got.select("subject_id", *[r6(F.col(f"`{n}`")).alias(n) for n in names])


@query("edge_list_lookup", f"""WITH {EDGES}, w(ch1, ch2) AS (VALUES ('n0', 'n3'), ('n1', 'n4'), ('n1', 'n9')) SELECT s.subject_id, w.ch1, w.ch2, round(coalesce(e.weight, 0), 6) + 0.0 AS weight
FROM (SELECT DISTINCT subject_id FROM ed) s CROSS JOIN w LEFT JOIN (SELECT * FROM ed WHERE freq_band = 'b1') e ON e.subject_id = s.subject_id AND e.ch1 = w.ch1 AND e.ch2 = w.ch2""")
def edge_list_lookup(spark, sf_dir):
    w = spark.createDataFrame([("n3", "n0"), ("n1", "n4"), ("n9", "n1"), ("n0", "n3")], "ch1 string, ch2 string")
    return rounded(N.lookup_edges(edges(spark, sf_dir).filter("freq_band = 'b1'"), w), "weight")


@query("avg_connectivity", f"WITH {POSITIVE} SELECT subject_id, freq_band, round(avg(weight), 6) AS weight FROM ed GROUP BY ALL")
def avg_connectivity(spark, sf_dir):
    return rounded(edges(spark, sf_dir, True).groupBy("subject_id", "freq_band").agg(F.avg("weight").alias("weight")), "weight")


@query("group_mean_matrix", f"WITH {EDGES} SELECT freq_band, ch1, ch2, round(avg(weight), 6) + 0.0 AS weight FROM ed GROUP BY ALL")
def group_mean_matrix(spark, sf_dir):
    return rounded(edges(spark, sf_dir).groupBy("freq_band", "ch1", "ch2").agg(F.avg("weight").alias("weight")), "weight")


@query("roi_within_connectivity", f"WITH {EDGES}, {ROIS} SELECT subject_id, freq_band, a.roi, round(avg(weight), 6) + 0.0 AS weight FROM ed JOIN ro a ON a.channel = ch1 JOIN ro b ON b.channel = ch2 AND a.roi = b.roi GROUP BY ALL")
def roi_within_connectivity(spark, sf_dir):
    return rounded(N.roi_within(edges(spark, sf_dir), ["subject_id", "freq_band"], _rois(spark)), "weight")


@query("roi_between_connectivity", f"""WITH {EDGES}, {ROIS}, sy AS (SELECT subject_id, freq_band, ch1, ch2, weight FROM ed UNION ALL SELECT subject_id, freq_band, ch2, ch1, weight FROM ed)
SELECT subject_id, freq_band, a.roi AS roi1, b.roi AS roi2, round(avg(weight), 6) + 0.0 AS weight FROM sy JOIN ro a ON a.channel = ch1 JOIN ro b ON b.channel = ch2 WHERE a.roi < b.roi GROUP BY ALL""")
def roi_between_connectivity(spark, sf_dir):
    return rounded(N.roi_between(edges(spark, sf_dir), ["subject_id", "freq_band"], _rois(spark)), "weight")


@query("node_degree", f"WITH {T} SELECT freq_band, node, count(*) AS degree FROM (SELECT freq_band, unnest([ch1, ch2]) AS node FROM t WHERE abs(t) > 1.0) GROUP BY ALL")
def node_degree(spark, sf_dir):
    return N.node_degree(N.threshold_edges(_t(spark, sf_dir), 1.0), ["freq_band"])


@query("region_involvement", f"""WITH {T}, {REGIONS}, x AS (SELECT freq_band, coalesce(region, 'Other') AS region, count(*) AS n_edges FROM (SELECT freq_band, unnest([ch1, ch2]) AS channel FROM t WHERE abs(t) > 1.0) LEFT JOIN rg USING (channel) GROUP BY ALL)
SELECT freq_band, region, n_edges, round(n_edges / sum(n_edges) OVER (PARTITION BY freq_band) * 100, 6) AS pct FROM x""")
def region_involvement(spark, sf_dir):
    return rounded(N.region_involvement(N.threshold_edges(_t(spark, sf_dir), 1.0), ["freq_band"], _regions(spark)), "pct")


@query("region_pair_counts", f"""WITH {T}, {REGIONS}, x AS (SELECT freq_band, coalesce(a.region, 'Other') AS r1, coalesce(b.region, 'Other') AS r2 FROM t LEFT JOIN rg a ON a.channel = ch1 LEFT JOIN rg b ON b.channel = ch2 WHERE abs(t) > 1.0)
SELECT freq_band, least(r1, r2) AS region1, greatest(r1, r2) AS region2, count(*) AS n FROM x GROUP BY ALL""")
def region_pair_counts(spark, sf_dir):
    return N.region_pair_counts(N.threshold_edges(_t(spark, sf_dir), 1.0), ["freq_band"], _regions(spark))


@query("component_mean", f"{COMP} SELECT ed.subject_id, freq_band, g1, g2, direction, component, round(avg(weight), 6) + 0.0 AS weight FROM ed JOIN ec USING (freq_band, ch1, ch2) GROUP BY ALL")
def component_mean(spark, sf_dir):
    return rounded(N.component_mean(edges(spark, sf_dir), _components(spark, sf_dir), BY), "weight")


CLUSTER = f"""{POSITIVE}, mx AS (SELECT subject_id, freq_band, max(weight) AS m FROM ed GROUP BY ALL),
en AS (SELECT subject_id, freq_band, ch1, ch2, cbrt(weight / m) AS w FROM ed JOIN mx USING (subject_id, freq_band)),
tr AS (SELECT a.subject_id, a.freq_band, a.ch1 AS x, a.ch2 AS y, b.ch2 AS z, a.w * b.w * c.w AS w FROM en a JOIN en b ON a.subject_id = b.subject_id AND a.freq_band = b.freq_band AND a.ch2 = b.ch1 JOIN en c ON c.subject_id = a.subject_id AND c.freq_band = a.freq_band AND c.ch1 = a.ch1 AND c.ch2 = b.ch2),
cl AS (SELECT subject_id, freq_band, sum(3 * 2 * w / 42) / 8 AS clustering FROM tr GROUP BY ALL)"""


@query("clustering_coefficient", f"WITH {CLUSTER} SELECT subject_id, freq_band, round(clustering, 6) AS clustering FROM cl")
def clustering_coefficient(spark, sf_dir):
    return rounded(N.clustering_coefficient(edges(spark, sf_dir, True), ["subject_id", "freq_band"]), "clustering")


PATHS = f"""{POSITIVE}, sy AS (SELECT subject_id, freq_band, ch1, ch2, weight FROM ed UNION ALL SELECT subject_id, freq_band, ch2, ch1, weight FROM ed),
p1 AS (SELECT a.subject_id, a.freq_band, a.ch1, b.ch2, min(a.weight + b.weight) AS d FROM (SELECT * FROM sy UNION ALL SELECT DISTINCT subject_id, freq_band, ch1, ch1, 0.0 FROM sy) a JOIN (SELECT * FROM sy UNION ALL SELECT DISTINCT subject_id, freq_band, ch1, ch1, 0.0 FROM sy) b ON a.subject_id = b.subject_id AND a.freq_band = b.freq_band AND a.ch2 = b.ch1 GROUP BY ALL),
p2 AS (SELECT a.subject_id, a.freq_band, a.ch1, b.ch2, min(a.d + b.d) AS d FROM p1 a JOIN p1 b ON a.subject_id = b.subject_id AND a.freq_band = b.freq_band AND a.ch2 = b.ch1 GROUP BY ALL),
p3 AS (SELECT a.subject_id, a.freq_band, a.ch1, b.ch2, min(a.d + b.d) AS d FROM p2 a JOIN p2 b ON a.subject_id = b.subject_id AND a.freq_band = b.freq_band AND a.ch2 = b.ch1 GROUP BY ALL)"""


@query("path_length", f"WITH {PATHS} SELECT subject_id, freq_band, round(sum(d) / 56, 6) AS path_length FROM p3 GROUP BY ALL")
def path_length(spark, sf_dir):
    return rounded(N.path_length(edges(spark, sf_dir, True), ["subject_id", "freq_band"]), "path_length")


@query("path_length_joined", f"WITH {PATHS} SELECT subject_id, freq_band, round(sum(d) / 56, 6) AS path_length FROM p3 GROUP BY ALL")
def path_length_joined(spark, sf_dir):
    """The same by joins, for networks of any size."""
    return rounded(N.path_length_joined(edges(spark, sf_dir, True), ["subject_id", "freq_band"]), "path_length")


#: Random graphs of a baseline, as in the studies.
GRAPHS = 50
# The networks here have 8 nodes and all 28 edges, and so have the random graphs: none is disconnected.
RANDOM = f"""rd AS (
  SELECT graph AS subject_id, 'r' AS freq_band, 'n' || lpad(i::VARCHAR, 6, '0') AS ch1, 'n' || lpad(j::VARCHAR, 6, '0') AS ch2,
         ('0x' || substr(md5('42|w|' || graph || '|' || i || '|' || j), 1, 13))::BIGINT / 4503599627370496.0 AS weight,
         row_number() OVER (PARTITION BY graph ORDER BY ('0x' || substr(md5('42|o|' || graph || '|' || i || '|' || j), 1, 13))::BIGINT, i, j) AS o
  FROM range(0, {GRAPHS}) g(graph), range(0, (SELECT count(DISTINCT c) FROM (SELECT unnest([ch1, ch2]) AS c FROM ed))) x(i), range(0, (SELECT count(DISTINCT c) FROM (SELECT unnest([ch1, ch2]) AS c FROM ed))) y(j)
  WHERE i < j QUALIFY o <= (SELECT count(*) FROM (SELECT DISTINCT ch1, ch2 FROM ed)))"""


def _of(text: str, names: tuple[str, ...], tag: str) -> str:
    """SQL of graph metrics over the random graphs: the same steps under other names."""
    import re

    for n in names:
        text = re.sub(rf"\b{n}\b(?!\.weight| *\()", f"{n}{tag}", text) if n != "ed" else re.sub(r"\bFROM ed\b", "FROM rd", text)
    return text


BASE = f"""{RANDOM}, {_of('mx AS' + CLUSTER.split(', mx AS', 1)[1], ('ed', 'mx', 'en', 'tr', 'cl'), '_r')}, {_of('sy AS' + PATHS.split(', sy AS', 1)[1], ('ed', 'sy', 'p1', 'p2', 'p3'), '_r')},
lr AS (SELECT subject_id, sum(d) / 56 AS l FROM p3_r GROUP BY 1),
ba AS (SELECT avg(clustering) AS c_rand, avg(l) AS l_rand, count(*) AS n_graphs FROM cl_r JOIN lr USING (subject_id))"""


def _random_baseline(spark, e):
    """Means over random graphs with the numbers of nodes and edges that the data's networks have."""
    n = e.select(F.explode(F.array("ch1", "ch2")).alias("c")).distinct().count()
    m = e.select("ch1", "ch2").distinct().count()
    return N.random_baseline(spark, GRAPHS, n, m)


@query("random_graph_baseline", f"WITH {POSITIVE}, {BASE} SELECT round(c_rand, 6) AS c_rand, round(l_rand, 6) AS l_rand, n_graphs FROM ba")
def random_graph_baseline(spark, sf_dir):
    return rounded(_random_baseline(spark, edges(spark, sf_dir, True)), "c_rand", "l_rand")


@query("small_world_sigma", f"""WITH {CLUSTER}, {PATHS.replace(POSITIVE + ", ", "")}, pl AS (SELECT subject_id, freq_band, sum(d) / 56 AS l FROM p3 GROUP BY ALL), av AS (SELECT subject_id, freq_band, avg(weight) AS a FROM ed GROUP BY ALL), {BASE}
SELECT subject_id, freq_band, round(clustering, 6) AS clustering, round(l, 6) AS path_length, round(a, 6) AS avg_connectivity, round((clustering / c_rand) / (l / l_rand), 6) AS sigma FROM cl JOIN pl USING (subject_id, freq_band) JOIN av USING (subject_id, freq_band), ba""")
def small_world_sigma(spark, sf_dir):
    e = edges(spark, sf_dir, True)
    got = N.small_world(e, ["subject_id", "freq_band"], _random_baseline(spark, e))
    return rounded(got, "clustering", "path_length", "avg_connectivity", "sigma")


@query("small_world_sigma_whole")
def small_world_sigma_whole(spark, sf_dir):
    return small_world_sigma(spark, sf_dir)
