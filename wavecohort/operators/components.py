"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.functions.scratch import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` reaches.

    Alternating large-star and small-star rounds on the edge table; each round is written to the shared folder, so
    that plans stay short and a lost executor costs one round at most. The number of rounds grows with the logarithm
    of the longest path. Nulls and loops are dropped; direction and repeats do not matter; no edge gives no row.
    """
    a, b = F.col(src), F.col(dst)
    now = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    now = written(now.distinct(), "edges")
    mark = _mark(now)
    spark = edges.sparkSession
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = written(_small_star(_large_star(now)), "stars")
        seen = _mark(after)
        done, mark = seen == mark, seen
        forget(spark, now)
        now = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    low = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return low.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
