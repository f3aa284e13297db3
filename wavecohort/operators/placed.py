"""Places, ranks and quantiles within keys of any size.

A window over a bare key sorts the key in one task. Here rows are dealt by ranges of (key, value) and written once with
their partition's number; each partition's totals are a small table, whose running sums are the offsets at which partitions
start; what is left is a window within (partition, key). A key that holds a third of all rows lies in a third of the
partitions. Null keys are keys like others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.functions.scratch import written

_BEFORE = (Window.unboundedPreceding, -1)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet; the left side's keys stay."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({k: f"__j{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__j{i}"]) for i, k in enumerate(keys)])
    return left.join(other, on, how).drop(*[f"__j{i}" for i in range(len(keys))])


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``__part``, the number of the range of (keys, order) that a row lies in; written."""
    return written(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def _offsets(placed: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """``__part, keys, __off, __all``: what lies in earlier parts of the key, and in all; a row for each part and key."""
    sums = placed.groupBy("__part", *keys).agg(total.alias("__s"))
    w = Window.partitionBy(*keys)
    return sums.select("__part", *keys, F.coalesce(F.sum("__s").over(w.orderBy("__part").rowsBetween(*_BEFORE)), F.lit(0)).alias("__off"), F.sum("__s").over(w).alias("__all"))


def running(df: DataFrame, keys: list[str], order: list[str], weight: str, before: str, whole: str) -> DataFrame:
    """Every row with the sums of ``weight`` over the rows of its key that come before it, and over all of them."""
    placed = ranged(df, keys, order)
    got = join_keys(placed, _offsets(placed, keys, F.sum(weight)), ["__part", *keys])
    within = F.coalesce(F.sum(weight).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(*_BEFORE)), F.lit(0))
    return got.select(*df.columns, (F.col("__off") + within).alias(before), F.col("__all").alias(whole))


def row_places(df: DataFrame, keys: list[str], order: list[str], place: str) -> DataFrame:
    """Every row with its place from 1 within its keys; ``order`` ends with a unique column."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), keys, order, "__one", place, "__n").withColumn(place, F.col(place) + 1).drop("__one", "__n")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, t, before, n``: distinct values with how often they occur, how many rows lie below, and the key's
    number of rows. Rows are folded into counts before anything is sorted; nulls have no part."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("t"))
    return running(counts, keys, [value], "t", "before", "n")


def at_place(place: Column, value: str) -> Column:
    """An aggregate over a distribution: the value of the row at a place from 0."""
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("t")), F.col(value)))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], more: dict[str, Column] | None = None) -> DataFrame:
    """``keys`` and a column for each probability: exact quantiles, linear between neighbours; ``more``: further aggregates
    over the distribution, in the same pass."""
    more = more or {}
    d = distribution(df, keys, value)
    h = {c: (F.col("n") - 1) * F.lit(float(p)) for c, p in probs.items()}
    ends = [at_place(f(x), value).alias(f"__{s}_{c}") for c, x in h.items() for s, f in (("lo", F.floor), ("hi", F.ceil))]
    got = d.groupBy(*keys, "n").agg(*ends, *[v.alias(c) for c, v in more.items()])
    between = {c: F.col(f"__lo_{c}") + (x - F.floor(x)) * (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")) for c, x in h.items()}
    return got.select(*keys, *[v.alias(c) for c, v in between.items()], *more)


def lowest_from_here(df: DataFrame, keys: list[str], order: list[str], rank: str, value: Column, name: str, counted: Column) -> DataFrame:
    """Every row with ``rank``, its place from 1 among the rows of its key where ``counted`` holds, and ``name``, the lowest
    ``value`` (which may use ``rank`` and ``__all``, the number of counted rows) from its place to the end of the key."""
    placed = ranged(df, keys, order)
    got = join_keys(placed, _offsets(placed, keys, F.count_if(counted)), ["__part", *keys])
    up = Window.partitionBy("__part", *keys).orderBy(*order)
    got = got.withColumn(rank, F.col("__off") + F.count_if(counted).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__v", F.when(counted, value))
    lows = got.groupBy("__part", *keys).agg(F.min("__v").alias("__low"))
    later = F.min("__low").over(Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(*_BEFORE))
    got = join_keys(got, lows.withColumn("__later", later).drop("__low"), ["__part", *keys])
    # From the end backwards: a frame that runs to the end is computed anew for every row. Rows that are not counted share
    # the rank of the last one that is, and come after it.
    down = Window.partitionBy("__part", *keys).orderBy(F.desc(rank), counted)
    here = F.min("__v").over(down.rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn(name, F.least(here, "__later")).drop("__part", "__off", "__v", "__later")
