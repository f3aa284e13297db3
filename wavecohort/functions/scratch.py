"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder of this machine only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="wavecohort-")
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps and lost executors read the files
    and never compute the plan twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a frame made by :func:`written` that nothing reads any more, and has the driver collect
    its garbage, so that Spark's cleaner drops the shuffle files of finished steps."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()
