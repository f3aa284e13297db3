"""Mixing sources to target weights by Poisson replication.

DataFrame functions only. Each source's repetition rate is its target share of the output over its share of the
input. A document's count is the Poisson quantile of a hash-seeded uniform number, so that it depends on the seed and the
document's id alone (without an id, on its text) and never on the partitioning. The copies are exploded and dealt out by a range partition
on a hash-derived shuffle key: a global shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.llm.common import inside, table, unit

#: Sources whose rates are broadcast (a few KB each at most); more are joined by a salted shuffle.
MAX_BROADCAST_SOURCES = 10_000
SALTS = 64


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, exponent: float = 0.5, total_factor: float = 1.0) -> DataFrame:
    """``source, n, weight, rate``. Target weights are given, or each source's count to the power ``exponent``; the
    output has ``total_factor`` times the input's rows on average. A source without a given weight has weight 0; a null
    source is a source of its own."""
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(exponent))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.try_element_at(F.create_map(*pairs), F.coalesce("source", F.lit(""))) if pairs else F.lit(0.0)
        raw = F.coalesce(raw, F.lit(0.0))
    n = n.withColumn("raw", raw)
    sums = n.agg(F.sum("n").alias("all_n"), F.sum(F.greatest("raw", F.lit(0.0))).alias("all_raw"))
    share = F.when(F.col("raw") > 0, F.col("raw") / F.col("all_raw")).otherwise(0.0)
    return n.crossJoin(F.broadcast(sums)).select(  # one row
        "source", "n", share.alias("weight"), (share * F.col("all_n") * total_factor / F.col("n")).alias("rate")
    )


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far enough into the tail that the rest is below 1e-16."""
    top = F.ceil(rate + 9 * F.sqrt(rate) + 20).cast("int")
    logs = F.aggregate(
        F.sequence(F.lit(1), top),
        F.array(-rate),
        lambda a, k: F.concat(a, F.array(F.element_at(a, -1) + F.log(rate) - F.log(k.cast("double")))),
    )
    sums = F.aggregate(
        logs,
        F.array().cast("array<double>"),
        lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + F.exp(x))),
    )
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    total_factor: float = 1.0,
    seed: int = 42,
    max_broadcast_sources: int = MAX_BROADCAST_SOURCES,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` replicated: every column, with ``mix_copy`` (from 1), ``mix_rate`` and ``mix_key`` (uniform in [0, 1),
    the global order). Columns of ``docs`` with these names are replaced.

    A row whose count is 0 goes. A row with a null id draws by its text, one without both as an empty string; a null
    source is a source of its own; repeated rows get equal counts and keys, each its own copies; a long text is one row
    like any other; an empty table gives an empty table. Columns of any other name stay as they are.
    """
    r = rates(docs, source_col, weights, exponent, total_factor)
    base = docs.drop("mix_copy", "mix_rate", "mix_key")
    u, own, rate, cdf, salt, n = inside(base, "u", "own_source", "rate", "cdf", "salt", "n")
    r = r.select(F.col("source").alias(own), F.col("rate").alias(rate), poisson_cdf(F.col("rate")).alias(cdf))
    told = F.coalesce(F.col(id_col).cast("string"), F.col(text_col)) if text_col in docs.columns else F.col(id_col)
    got = base.withColumn(u, unit(F.lit("count"), told, seed=seed))
    if r.limit(max_broadcast_sources + 1).count() <= max_broadcast_sources:
        got = got.join(F.broadcast(r), F.col(source_col).eqNullSafe(F.col(own)))
    else:
        r = r.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        got = got.withColumn(salt, F.floor(F.col(u) * SALTS).cast("int")).join(r, F.col(source_col).eqNullSafe(F.col(own)) & (F.col(salt) == F.col(n))).drop(n)
    got = got.withColumn(n, F.size(F.filter(cdf, lambda p: p <= F.col(u)))).filter(F.col(n) > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    got = got.withColumns({"mix_rate": F.col(rate), "mix_key": unit(F.lit("order"), told, F.col("mix_copy"), seed=seed)})
    return got.select(*base.columns, "mix_copy", "mix_rate", "mix_key")


def shuffled(mixed: DataFrame, id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Dealt out by ranges of ``mix_key`` and sorted within them: read in order, the files are in a global random order."""
    by = [F.col("mix_key"), F.col(id_col), F.col("mix_copy")]
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, *by).sortWithinPartitions(*by)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = shuffled(mix(docs))
    return mixed.select("doc_id", "source", "text", "mix_copy", F.round("mix_rate", 9).alias("mix_rate"), "mix_key")


SQL = r"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () * sum(n) OVER () / n AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, 1 + CAST(ceil(rate + 9 * sqrt(rate) + 20) AS BIGINT))) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS pmf FROM k),
c AS (SELECT source, rate, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('42|count|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
t AS (SELECT doc_id, u.source, text, rate, count(*) AS copies FROM u JOIN c ON u.source = c.source AND c.cdf <= u.u GROUP BY ALL),
e AS (SELECT doc_id, source, text, rate, unnest(range(1, copies + 1)) AS mix_copy FROM t)
SELECT doc_id, source, text, mix_copy::INTEGER AS mix_copy, round(rate, 9) AS mix_rate,
       ('0x' || substr(md5('42|order|' || doc_id || '|' || mix_copy), 1, 13))::BIGINT / 4503599627370496.0 AS mix_key
FROM e
"""
