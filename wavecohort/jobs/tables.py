"""Queries of reading, cleaning, filtering, joining, reshaping and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavecohort.functions import expr as X
from wavecohort.functions.scratch import shared_dir
from wavecohort.jobs.base import METRICS, metrics, query, r6, table
from wavecohort.operators import select as S
from wavecohort.sources import tables as T


def _path(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_group_csvs", """SELECT l_orderkey::VARCHAR AS subject_id, l_linenumber AS epoch, l_quantity AS value, l_returnflag AS grp FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def read_group_csvs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    paths = {}
    for g in ("A", "N", "missing"):
        paths[g] = _path(spark, f"group-{g}")
        if g != "missing":
            li.filter(F.col("l_returnflag") == g).select(F.col("l_orderkey").cast("string").alias("subject_id"), F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("value")).write.csv(paths[g], header=True)
    return T.read_group_tables(spark, paths, "subject_id string, epoch int, value double")


BEHAVIOR = "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"


def _behavior(spark, sf_dir):
    """Outcomes as a CSV file of other hands: empty fields where there is none, and every fiftieth line broken."""
    d, la = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.coalesce(F.col("quality").cast("string"), F.lit("")))
    broken = F.when(F.col("doc_id") % 100 == 0, F.concat(line, F.lit(",9,9"))).otherwise(F.concat(F.lit("no. "), line))
    path = _path(spark, "behavior")
    d.join(la, "doc_id", "left").select(F.when(F.col("doc_id") % 50 == 0, broken).otherwise(line).alias("value")).write.text(path)
    return T.read_behavior(spark, path, "doc_id long, quality int", "quality", header=False)


@query("read_behavior", f"SELECT doc_id, quality FROM ({BEHAVIOR}) WHERE quality IS NOT NULL AND doc_id % 50 <> 0")
def read_behavior(spark, sf_dir):
    return _behavior(spark, sf_dir)[0]


@query("read_behavior_rejected", f"SELECT CASE WHEN doc_id % 100 = 0 THEN '' ELSE 'no. ' END || doc_id || ',' || coalesce(quality::VARCHAR, '') || CASE WHEN doc_id % 100 = 0 THEN ',9,9' ELSE '' END AS record FROM ({BEHAVIOR}) WHERE doc_id % 50 = 0")
def read_behavior_rejected(spark, sf_dir):
    return _behavior(spark, sf_dir)[1]


@query("discover_subjects", "SELECT s_nationkey::VARCHAR AS grp, s_suppkey::VARCHAR AS subject_id FROM supplier WHERE s_suppkey % 3 <> 0")
def discover_subjects(spark, sf_dir):
    """A folder of recordings by group and subject, listed; files of other kinds lie beside them."""
    path = _path(spark, "recordings")
    end = F.when(F.col("s_suppkey") % 3 == 0, ".txt").otherwise("-epo.parquet")
    made = table(spark, sf_dir, "supplier").select("s_acctbal", F.col("s_nationkey").alias("grp"), F.concat(F.col("s_suppkey").cast("string"), end).alias("file"))
    T.write_recordings(made, "grp", "file", path)
    return T.discover_subjects(T.list_files(spark, path))


@query("explode_signal", """SELECT vec_id, (unnest(range(0, 64)))::INTEGER AS sample_idx, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings""")
def explode_signal(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    return T.explode_samples(e).withColumn("value", r6(F.col("value").cast("double")))


@query("collect_signal", """SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 6) AS weighted FROM embeddings""")
def collect_signal(spark, sf_dir):
    e = T.explode_samples(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples")))
    back = T.collect_samples(e, ["vec_id"])
    w = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return back.select("vec_id", F.size("samples").alias("n"), r6(w).alias("weighted"))


@query("write_results_csv", """SELECT n_name AS metric, n_regionkey AS band, n_nationkey AS value FROM nation""")
def write_results_csv(spark, sf_dir):
    path = _path(spark, "results")
    T.write_results(table(spark, sf_dir, "nation").select(F.col("n_name").alias("metric"), F.col("n_regionkey").alias("band"), F.col("n_nationkey").alias("value")), path)
    return spark.read.schema("metric string, band int, value int").csv(path, header=True)


@query("write_matrix_store", """SELECT l_suppkey AS subject_id, l_partkey AS ch1, l_quantity AS weight FROM lineitem WHERE l_linestatus = 'F'""")
def write_matrix_store(spark, sf_dir):
    path = _path(spark, "edges")
    li = table(spark, sf_dir, "lineitem")
    T.write_edges(li.select(F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("ch1"), F.col("l_quantity").alias("weight"), F.col("l_linestatus").alias("freq_band")), path)
    return spark.read.parquet(path).filter("freq_band = 'F'").select("subject_id", "ch1", "weight")


DIRTY = "CASE c_custkey % 5 WHEN 0 THEN c_custkey || '（71.5）' WHEN 1 THEN '-999' WHEN 2 THEN '' WHEN 3 THEN 'abc' ELSE c_acctbal::VARCHAR END"


def _dirty(spark, sf_dir):
    k = F.col("c_custkey") % 5
    return table(spark, sf_dir, "customer").withColumn(
        "raw", F.when(k == 0, F.concat(F.col("c_custkey").cast("string"), F.lit("（71.5）"))).when(k == 1, "-999").when(k == 2, "").when(k == 3, "abc").otherwise(F.col("c_acctbal").cast("string"))
    )


@query("clean_behavior", f"""SELECT nullif(regexp_extract(c_name, '(\\d+)', 1), '') AS subject_id,
  nullif(try_cast(nullif(regexp_extract(raw, '^(-?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE), -999) AS value FROM (SELECT c_name, {DIRTY} AS raw FROM customer)""")
def clean_behavior(spark, sf_dir):
    return _dirty(spark, sf_dir).select(X.digits_id("c_name").alias("subject_id"), X.leading_number("raw").alias("value"))


@query("strip_non_numeric", f"""SELECT c_custkey, try_cast(regexp_replace(raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value FROM (SELECT c_custkey, {DIRTY} AS raw FROM customer)""")
def strip_non_numeric(spark, sf_dir):
    return _dirty(spark, sf_dir).select("c_custkey", X.strip_non_numeric("raw").alias("value"))


@query("strip_prefix_id", """SELECT c_custkey, substr(c_name, 10) AS a, replace(c_name, 'Customer#', '') AS b FROM customer""")
def strip_prefix_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.strip_prefix("c_name", 9).alias("a"), F.replace("c_name", F.lit("Customer#"), F.lit("")).alias("b"))


@query("pad_ids", """SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS id, c_name AS other FROM customer""")
def pad_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.pad_id("c_custkey").alias("id"), X.pad_id("c_name").alias("other"))


@query("lower_labels", "SELECT c_custkey, lower(c_mktsegment) AS grp FROM customer")
def lower_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("grp"))


@query("missing_report", f"""WITH x AS (SELECT c_custkey, try_cast(regexp_replace(raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value, nullif(raw, '') AS raw FROM (SELECT c_custkey, {DIRTY} AS raw FROM customer))
SELECT 'c_custkey' AS "column", count(*) FILTER (c_custkey IS NULL) AS n_missing, count(c_custkey) AS n_valid FROM x
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), count(value) FROM x UNION ALL SELECT 'raw', count(*) FILTER (raw IS NULL), count(raw) FROM x""")
def missing_report(spark, sf_dir):
    x = _dirty(spark, sf_dir).select("c_custkey", X.strip_non_numeric("raw").alias("value"), F.nullif("raw", F.lit("")).alias("raw"))
    return T.missing_report(x)


@query("log_power", "SELECT l_orderkey, l_linenumber, round(log10(l_discount + 1e-20), 9) AS log_power FROM lineitem")
def log_power(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(X.log_power("l_discount"), 9).alias("log_power"))


@query("neg_log10_p", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(-log10(l_tax), 9) ELSE 10.0 END AS x FROM lineitem")
def neg_log10_p(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(X.neg_log10_p("l_tax"), 9).alias("x"))


@query("significance_stars", """SELECT p_partkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '†' ELSE '' END AS stars FROM (SELECT p_partkey, (p_partkey % 1000) / 5000.0::DOUBLE AS p FROM part)""")
def significance_stars(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.stars((F.col("p_partkey") % 1000) / F.lit(5000.0), trend=True).alias("stars"))


@query("label_bins", "SELECT p_partkey, CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'middle' ELSE 'low' END AS label FROM part")
def label_bins(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.bins("p_size", [(35, "high"), (15, "middle")], "low").alias("label"))


@query("group_lookup", "SELECT doc_id, coalesce(quality::VARCHAR, 'unknown') AS grp FROM documents LEFT JOIN labels USING (doc_id)")
def group_lookup(spark, sf_dir):
    la = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("grp"))
    return S.group_lookup(table(spark, sf_dir, "documents").select("doc_id"), la, "doc_id")


@query("select_subjects", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')")
def select_subjects(spark, sf_dir):
    return S.select_subjects(table(spark, sf_dir, "customer"), ["MACHINERY", "HOUSEHOLD"], "c_mktsegment").select("c_custkey")


@query("filter_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'")
def filter_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_type").startswith("S")).select("p_partkey", "p_type")


@query("drop_channels", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'F9')")
def drop_channels(spark, sf_dir):
    return S.drop_listed(table(spark, sf_dir, "events"), "event_type", ["error", "F9"]).select("event_id", "event_type")


def _seconds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    start = e.groupBy("user_id").agg(F.min("us").alias("us0"))
    return e.join(start, "user_id").select("event_id", "user_id", ((F.col("us") - F.col("us0")) / 1e6).alias("t"))


@query("crop_middle", """WITH t AS (SELECT event_id, user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t FROM events),
d AS (SELECT user_id, max(t) AS d FROM t GROUP BY 1)
SELECT event_id, user_id FROM t JOIN d USING (user_id) WHERE CASE WHEN d <= 2000000 THEN true ELSE t BETWEEN (d - 2000000) / 2 AND d - (d - 2000000) / 2 END""")
def crop_middle(spark, sf_dir):
    return S.crop_middle(_seconds(spark, sf_dir), ["user_id"], "t", 2_000_000.0).select("event_id", "user_id")


@query("binary_recode", """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority IN ('5-LOW') THEN 'low' END AS cls FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def binary_recode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cls", X.recode("o_orderpriority", {"high": ["1-URGENT", "2-HIGH"], "low": ["5-LOW"]}))
    return o.filter(F.col("cls").isNotNull()).select("o_orderkey", "cls")


@query("bad_epoch_filter", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 200)")
def bad_epoch_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return S.unmatched(e, e.groupBy("user_id").agg(F.max("value").alias("m")).filter("m > 200"), "user_id").select("event_id")


@query("join_behavior_connectivity", "SELECT o_custkey AS subject_id, round(avg(o_totalprice), 6) AS avg_weight, count(*) AS n_edges, any_value(c_acctbal) AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_behavior_connectivity(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_totalprice").alias("weight"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_acctbal")
    return S.join_outcome(o, c).withColumn("avg_weight", r6("avg_weight"))


@query("unmatched_subjects", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_subjects(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return S.unmatched(c, table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("matched_subjects", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def matched_subjects(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return S.keep_matched(c, table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("map_then_filter", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 2)")
def map_then_filter(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    return S.select_subjects(table(spark, sf_dir, "supplier").join(n, "s_nationkey", "left"), [0, 2], "n_regionkey").select("s_suppkey", "n_name")


@query("merge_results", """SELECT l_returnflag, p.n, round(p.r, 9) AS r_a, round(q.r, 9) AS r_b FROM (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1) p
JOIN (SELECT l_returnflag, count(*) AS n, corr(l_discount, l_extendedprice) AS r FROM lineitem GROUP BY 1) q USING (l_returnflag)""")
def merge_results(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    one, two = (li.agg(F.count("*").alias("n"), F.corr(x, "l_extendedprice").alias("r")) for x in ("l_quantity", "l_discount"))
    return S.merge_results(one, two, ["l_returnflag", "n"], ("a", "b")).withColumns({"r_a": r6("r_a", 9), "r_b": r6("r_b", 9)})


BANDS = [("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 45.0)]


@query("band_range_join", """WITH b(band, fmin, fmax) AS (VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 45.0))
SELECT band, count(*) AS n, round(avg(l_extendedprice), 4) AS power FROM lineitem JOIN b ON l_quantity >= fmin AND l_quantity < fmax GROUP BY 1""")
def band_range_join(spark, sf_dir):
    bands = spark.createDataFrame(BANDS, "band string, fmin double, fmax double")
    got = S.range_join(table(spark, sf_dir, "lineitem"), bands, "l_quantity").groupBy("band").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("power"))
    return got.withColumn("power", r6("power", 4))


@query("region_join", "SELECT s_suppkey, CASE WHEN n_regionkey < 3 THEN n_name ELSE 'Other' END AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def region_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region"))
    return S.group_lookup(table(spark, sf_dir, "supplier"), n, "s_nationkey", "region", "Other").select("s_suppkey", "region")


@query("cross_pairs_bands", "SELECT a.r_name AS g1, b.r_name AS g2, band, thr FROM region a JOIN region b ON a.r_name < b.r_name, (VALUES ('delta'), ('theta')) x(band), (VALUES (2.0::DOUBLE), (3.0::DOUBLE)) y(thr)")
def cross_pairs_bands(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    pairs = r.select(F.col("r_name").alias("g1")).join(r.select(F.col("r_name").alias("g2")), F.col("g1") < F.col("g2"))
    grid = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(t).alias("thr")) for b in ("delta", "theta") for t in (2.0, 3.0)]))
    return pairs.select("g1", "g2", grid.alias("x")).select("g1", "g2", "x.band", "x.thr")  # settings: a handful of rows


@query("value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))


@query("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_subjects, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("n_subjects"), F.countDistinct("l_partkey").alias("n_parts"))


@query("describe_power", "SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(median(l_extendedprice), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM lineitem")
def describe_power(spark, sf_dir):
    x = "l_extendedprice"
    got = table(spark, sf_dir, "lineitem").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return got.select("n", r6("mean", 4).alias("mean"), r6("std", 4).alias("std"), *[r6(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


@query("descriptive_by_band", """SELECT l_linestatus AS freq_band, round(avg(l_quantity), 4) AS quantity_mean, round(stddev_samp(l_quantity), 4) AS quantity_std, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max,
 round(avg(l_tax), 4) AS tax_mean, round(stddev_samp(l_tax), 4) AS tax_std, min(l_tax) AS tax_min, max(l_tax) AS tax_max FROM lineitem GROUP BY 1""")
def descriptive_by_band(spark, sf_dir):
    fs = (("mean", lambda c: F.round(F.avg(c), 4)), ("std", lambda c: F.round(F.stddev_samp(c), 4)), ("min", F.min), ("max", F.max))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("freq_band")).agg(*[f(f"l_{m}").alias(f"{m}_{n}") for m in ("quantity", "tax") for n, f in fs])


@query("significant_by_dim", """SELECT o_orderstatus AS roi, o_orderpriority AS band, count(*) FILTER (o_totalprice > 300000) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def significant_by_dim(spark, sf_dir):
    return spark.sql("SELECT o_orderstatus AS roi, o_orderpriority AS band, count_if(o_totalprice > 300000) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", orders=table(spark, sf_dir, "orders"))


@query("pivot_counts", """SELECT l_shipdate::DATE - date_trunc('year', l_shipdate)::DATE AS day, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def pivot_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("day", (F.dayofyear("l_shipdate") - 1).cast("long"))
    return T.long_to_wide(li, ["day"], "l_returnflag", ["A", "N", "R"], "l_orderkey", F.count, 0)


@query("pivot_p", f"""WITH {METRICS} SELECT metric, round(avg(value) FILTER (freq_band = 'F'), 6) AS "F", round(avg(value) FILTER (freq_band = 'O'), 6) AS "O" FROM m GROUP BY 1""")
def pivot_p(spark, sf_dir):
    got = T.long_to_wide(metrics(spark, sf_dir), ["metric"], "freq_band", ["F", "O"], "value", F.avg)
    return got.withColumns({"F": r6("F"), "O": r6("O")})


@query("unpivot_bands", "SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) AS band, unnest([l_discount, l_tax]) AS power FROM lineitem")
def unpivot_bands(spark, sf_dir):
    return T.wide_to_long(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "band", "power")


@query("subject_level_summary", f"""WITH {METRICS} SELECT subject_id, grp, round(avg(value) FILTER (metric = 'quantity' AND freq_band = 'F'), 6) AS "quantity_F", round(avg(value) FILTER (metric = 'quantity' AND freq_band = 'O'), 6) AS "quantity_O",
 round(avg(value) FILTER (metric = 'tax' AND freq_band = 'F'), 6) AS "tax_F", round(avg(value) FILTER (metric = 'tax' AND freq_band = 'O'), 6) AS "tax_O" FROM m GROUP BY 1, 2""")
def subject_level_summary(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("cell", F.concat_ws("_", "metric", "freq_band"))
    names = ["quantity_F", "quantity_O", "tax_F", "tax_O"]
    return T.long_to_wide(m, ["subject_id", "grp"], "cell", names, "value", F.avg).withColumns({c: r6(c) for c in names})


@query("zscore", """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) / stddev_pop(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS z FROM customer""")
def zscore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("z"))
    return S.zscore(c, ["c_mktsegment"], ["z"]).select("c_custkey", r6("z").alias("z"))


@query("top_edges", """SELECT l_returnflag, l_orderkey, l_linenumber, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 20""")
def top_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    got = S.top_per_group(li, ["l_returnflag"], 20, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return got.select("l_returnflag", "l_orderkey", "l_linenumber", "rank")


@query("head_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def head_n(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15).select("p_partkey", "p_retailprice")


@query("region_order", "SELECT n_regionkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, n_regionkey)::INTEGER AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def region_order(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    counts = table(spark, sf_dir, "supplier").join(n, "s_nationkey").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "n_regionkey")))  # a row for each region


@query("union_groups", "SELECT c_custkey AS id, 'c' AS grp FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def union_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("grp"))
    return S.union_all(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("grp")))


LINKS = """a AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS ch1, greatest(l_suppkey, l_partkey % 100) AS ch2 FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40),
b AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS ch1, greatest(l_suppkey, l_partkey % 100) AS ch2 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)"""


def _two(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    pick = lambda g: li.filter(F.col("l_returnflag") == g).select(F.col("l_suppkey").alias("ch1"), (F.col("l_partkey") % 100).alias("ch2"))
    return pick("A"), pick("R")


@query("shared_edges", f"WITH {LINKS} SELECT * FROM a INTERSECT SELECT * FROM b")
def shared_edges(spark, sf_dir):
    return S.shared_edges(*_two(spark, sf_dir))


@query("unique_edges", f"WITH {LINKS} SELECT * FROM a EXCEPT SELECT * FROM b")
def unique_edges(spark, sf_dir):
    return S.unique_edges(*_two(spark, sf_dir))


@query("edge_class_code", f"WITH {LINKS}, x AS (SELECT *, 1 AS v FROM a UNION ALL SELECT *, 2 FROM b) SELECT ch1, ch2, sum(v)::INTEGER AS code FROM x GROUP BY ALL")
def edge_class_code(spark, sf_dir):
    return S.edge_classes(*_two(spark, sf_dir))


@query("stratified_kfold", "SELECT vec_id, ((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) - 1) % 5)::INTEGER AS fold FROM embeddings")
def stratified_kfold(spark, sf_dir):
    return S.stratified_folds(table(spark, sf_dir, "embeddings"), "label", "vec_id", 5).select("vec_id", "fold")
