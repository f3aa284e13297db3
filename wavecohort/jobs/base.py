"""Stand-ins for study tables, derived from the given tables, and a register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as a query, with the SQL that states it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; + 0.0 turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject-level metrics of three groups: ``metric, freq_band, grp, subject_id, value``."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("freq_band"),
        F.col("l_returnflag").alias("grp"),
        F.col("l_suppkey").alias("subject_id"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    return li.unpivot(["freq_band", "grp", "subject_id"], ["quantity", "price", "discount", "tax"], "metric", "value")


METRICS = """m AS (
  SELECT l_linestatus AS freq_band, l_returnflag AS grp, l_suppkey AS subject_id,
         unnest(['quantity', 'price', 'discount', 'tax']) AS metric,
         unnest([l_quantity, l_extendedprice / 1000, l_discount, l_tax]) AS value
  FROM lineitem)"""

KEYS = ["metric", "freq_band"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-length epochs: ``subject_id, grp, epoch_idx, channel, samples``: 64 samples at 64 Hz, four channels."""
    e = table(spark, sf_dir, "embeddings")
    epoch = F.floor(F.col("vec_id") / 4)
    return e.select(
        (epoch % 8).cast("long").alias("subject_id"),
        F.concat(F.lit("g"), (epoch % 3).cast("string")).alias("grp"),
        epoch.cast("long").alias("epoch_idx"),
        F.concat(F.lit("c"), (F.col("vec_id") % 4).cast("string")).alias("channel"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )


SAMPLES = """e AS (
  SELECT (vec_id // 4) % 8 AS subject_id, 'g' || ((vec_id // 4) % 3) AS grp, vec_id // 4 AS epoch_idx,
         'c' || (vec_id % 4) AS channel, list_transform(embedding, lambda x: x::DOUBLE) AS samples
  FROM embeddings)"""

LONG = (
    SAMPLES
    + """,
s AS (SELECT subject_id, grp, epoch_idx, channel, unnest(range(0, 64)) AS sample_idx, unnest(samples) AS value FROM e)"""
)


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped samples of users: ``subject_id, channel, ts, value``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
