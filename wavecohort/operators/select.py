"""Filters, joins and set operations of study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.operators.placed import row_places


#: Rows of a side that is broadcast; one of more rows is joined by a shuffle.
MAX_SIDE = 100_000


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """A side of an equi-join that is a list of the montage or of the job, broadcast if it is counted to be small."""
    most = MAX_SIDE if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def group_lookup(df: DataFrame, groups: DataFrame, key: str, group_col: str = "grp", other: str = "unknown") -> DataFrame:
    """Each row with its subject's group, ``other`` for subjects without one. ``groups``: ``key, group_col``, a row for
    each subject; Spark broadcasts it if it is small."""
    return df.join(groups, key, "left").withColumn(group_col, F.coalesce(group_col, F.lit(other)))


def select_subjects(df: DataFrame, wanted: list[str] | str, group_col: str = "grp") -> DataFrame:
    """Rows of the groups named, or all."""
    return df if wanted == "all" else df.filter(F.col(group_col).isin(wanted))


def keep_matched(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other, key, "left_semi")


def unmatched(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other, key, "left_anti")


def drop_listed(df: DataFrame, column: str, listed: list[str]) -> DataFrame:
    """Without rows of the names listed; names that do not occur do not matter."""
    return df.filter(~F.coalesce(F.col(column).isin(listed), F.lit(False))) if listed else df


def crop_middle(df: DataFrame, keys: list[str], t: str, keep: float, on_short: str = "keep") -> DataFrame:
    """The middle ``keep`` seconds of every recording; a shorter one stays whole (``keep``) or goes (``drop``). ``t`` is in
    seconds from the recording's start; a recording lasts to its last sample."""
    size = df.groupBy(*keys).agg(F.max(t).alias("__d"))
    got = df.join(size, keys)
    trim = (F.col("__d") - keep) / 2
    inside = F.col(t).between(trim, F.col("__d") - trim)
    short = F.col("__d") <= keep
    return got.filter(F.when(short, F.lit(on_short == "keep")).otherwise(inside)).drop("__d")


def join_outcome(edges: DataFrame, outcome: DataFrame, key: str = "subject_id") -> DataFrame:
    """Each subject's mean weight with its row of the outcome table; subjects of one side alone are left out."""
    return edges.groupBy(key).agg(F.avg("weight").alias("avg_weight"), F.count("*").alias("n_edges")).join(outcome, key)


def merge_results(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Two tables of results side by side, other columns with a suffix each."""
    tag = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in keys])
    return tag(left, names[0]).join(tag(right, names[1]), keys)


def range_join(points: DataFrame, bands: DataFrame, x: str, closed: bool = False) -> DataFrame:
    """Points with every band ``[fmin, fmax)`` (or ``[fmin, fmax]``) that they lie in. ``bands`` is a small table of the
    job's settings."""
    top = F.col(x) <= F.col("fmax") if closed else F.col(x) < F.col("fmax")
    return points.join(F.broadcast(bands), (F.col(x) >= F.col("fmin")) & top)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def undirected(edges: DataFrame, a: str = "ch1", b: str = "ch2") -> DataFrame:
    """Each edge with the smaller end first."""
    return edges.withColumns({a: F.least(F.col(a), F.col(b)), b: F.greatest(F.col(a), F.col(b))})


def edge_classes(one: DataFrame, two: DataFrame) -> DataFrame:
    """``ch1, ch2, code``: 1 only in the first table, 2 only in the second, 3 in both, whatever the direction."""
    a = undirected(one).select("ch1", "ch2").distinct().withColumn("a", F.lit(1))
    b = undirected(two).select("ch1", "ch2").distinct().withColumn("b", F.lit(2))
    return a.join(b, ["ch1", "ch2"], "full").select("ch1", "ch2", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("code"))


def shared_edges(one: DataFrame, two: DataFrame) -> DataFrame:
    return undirected(one).select("ch1", "ch2").intersect(undirected(two).select("ch1", "ch2"))


def unique_edges(one: DataFrame, two: DataFrame) -> DataFrame:
    return undirected(one).select("ch1", "ch2").subtract(undirected(two).select("ch1", "ch2"))


def top_per_group(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` rows of each key, with their ``rank``. ``order`` has to end with a unique column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def zscore(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation, within keys; a constant column gives 0. Means come from
    an aggregation that is joined back, so that no key is sorted or gathered."""
    moments = df.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    got = df.join(moments, keys) if keys else df.crossJoin(F.broadcast(moments))  # one row
    z = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in columns}
    return got.withColumns(z).select(*df.columns)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1, dealt within each class in the order of a hash of the key, by ranges of (class, hash)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    placed = row_places(df.withColumn("__h", h), [label], ["__h", key], "fold")
    return placed.withColumn("fold", ((F.col("fold") - 1) % k).cast("int")).drop("__h")
