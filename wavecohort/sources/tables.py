"""Reading and writing study tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavecohort.functions.scratch import written


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_group_tables(spark: SparkSession, paths: dict[str, str], schema: StructType | str | None = None, kind: str = "csv", group_col: str = "grp") -> DataFrame:
    """One table for each group, stamped with the group and stacked; paths that are not there are left out. CSV needs
    an explicit schema, with ids as strings."""
    read = lambda p: spark.read.schema(schema).csv(p, header=True) if kind == "csv" else spark.read.parquet(p)
    there = {g: p for g, p in paths.items() if _exists(spark, p)}
    if not there:
        raise FileNotFoundError(f"none of {sorted(paths.values())}")
    return reduce(DataFrame.unionByName, [read(p).withColumn(group_col, F.lit(g)) for g, p in there.items()])


def read_behavior(spark: SparkSession, path: str, schema: str, key: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """A CSV table of outcomes: its rows without those that are empty or lack the key, and apart from them the ``record``
    of every line that does not fit the schema (too few or too many fields, a text where a number belongs). A mark at the
    file's start is no part of the first name, since names come from the schema."""
    read = spark.read.schema(f"{schema}, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").csv(path, header=header)
    read = written(read, "parsed")  # lines are parsed once for both
    bad = read.filter("__bad IS NOT NULL").select(F.col("__bad").alias("record"))
    return drop_empty(read.filter("__bad IS NULL").drop("__bad"), key), bad


def drop_empty(df: DataFrame, key: str) -> DataFrame:
    """Without rows that are null in every column or in the key."""
    return df.na.drop(how="all").na.drop(subset=[key])


def discover_subjects(files: DataFrame, path_col: str = "path", suffix: str = "-epo.parquet") -> DataFrame:
    """``grp, subject_id`` from paths of the form ``.../<group>/<subject><suffix>``, a file or a folder of part files, with
    or without ``name=`` before either as Spark's partitions have it; other paths are left out."""
    pattern = r"(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?([^/=]+)" + suffix.replace(".", r"\.") + r"(?:/[^/]*)?$"
    got = files.filter(F.col(path_col).rlike(pattern))
    return got.select(F.regexp_extract(path_col, pattern, 1).alias("grp"), F.regexp_extract(path_col, pattern, 2).alias("subject_id")).distinct()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the files of a folder tree, without their contents. Spark cuts a task for each 32 files, as if it read
    them; for a list a few tasks do."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return got.coalesce(4 * spark.sparkContext.defaultParallelism)


def _arrow_reaches(path: str) -> bool:
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (ValueError, OSError, NotImplementedError):  # no such kind of store, or none of its libraries here
        return False
    return True


def write_recordings(df: DataFrame, group: str, file: str, folder: str) -> None:
    """A Parquet file ``<folder>/<name of the group's column>=<group>/<file>`` for each pair of names, with its rows in the
    other columns; rows without a file's name are left out. Tasks write the files of their rows through Arrow, since Spark's writer makes, moves and
    commits a folder for each; it still does so in stores that Arrow does not reach."""
    columns = [c for c in df.columns if c not in (group, file)]
    name = F.coalesce(F.col(group).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))  # as Spark names it
    rows = df.filter(F.col(file).isNotNull()).withColumn(group, name).repartition(df.sparkSession.sparkContext.defaultParallelism, group, file)
    if not _arrow_reaches(folder):
        rows.write.partitionBy(group, file).parquet(folder)
        return

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import Table, fs, parquet

        store, root = fs.FileSystem.from_uri(folder)
        made = set()

        def write(f: pd.DataFrame) -> pd.DataFrame:
            for (g, x), own in f.groupby([group, file], sort=False):
                if g not in made:
                    store.create_dir(f"{root}/{group}={g}", recursive=True)
                    made.add(g)
                parquet.write_table(Table.from_pandas(own[columns], preserve_index=False), f"{root}/{group}={g}/{x}", filesystem=store)
            return pd.DataFrame({"n": [len(f)]})

        held = None  # rows of the last file of a batch, which may go on in the next
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if len(f):
                last = (f[group] == f[group].iloc[-1]) & (f[file] == f[file].iloc[-1])
                held = f[last]
                yield write(f[~last])
        if held is not None:
            yield write(held)

    rows.sortWithinPartitions(group, file).mapInPandas(put, "n long").agg(F.sum("n")).collect()  # one row


def explode_samples(df: DataFrame, samples: str = "samples") -> DataFrame:
    """One row for each sample: ``sample_idx`` (from 0) and ``value``."""
    return df.select(*[c for c in df.columns if c != samples], F.posexplode(samples).alias("sample_idx", "value"))


def collect_samples(df: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """Samples of each key put together again in the order of ``sample_idx``."""
    pairs = F.array_sort(F.collect_list(F.struct("sample_idx", "value")))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["value"]).alias(samples))


def write_results(df: DataFrame, path: str, mark: bool = True) -> None:
    """A small table of results as one CSV file with a header, in UTF-8; with the ``mark`` at its start by which
    spreadsheet programs know that."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, f"\ufeff{first}") if mark else df
    out.coalesce(1).write.mode("overwrite").option("encoding", "UTF-8").csv(path, header=True)


def write_edges(edges: DataFrame, path: str, band: str = "freq_band") -> None:
    """Connectivity by band, so that a job on one band reads its folder alone."""
    edges.write.mode("overwrite").partitionBy(band).parquet(path)


def missing_report(df: DataFrame) -> DataFrame:
    """``column, n_missing, n_valid``: one pass over the table. NaN counts as missing."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    row = df.agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(gone(c).cast("long")), F.lit(0)).alias(c) for c in df.columns])
    got = row.unpivot("__n", df.columns, "column", "n_missing")
    return got.select("column", "n_missing", (F.col("__n") - F.col("n_missing")).alias("n_valid"))


def wide_to_long(df: DataFrame, ids: list[str], names: list[str], name_col: str, value_col: str) -> DataFrame:
    return df.unpivot(ids, names, name_col, value_col)


def long_to_wide(df: DataFrame, ids: list[str], name: Column | str, names: list[str], value: str, how=F.first, fill: float | None = None) -> DataFrame:
    """A column for each of ``names``, which are given so that the table is not read once more to find them."""
    got = df.groupBy(*ids).pivot(name, names).agg(how(value))
    return got if fill is None else got.na.fill(fill, subset=names)
