"""Epochs of time-stamped signals by event time, for batch and streaming tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_epochs(df: DataFrame, keys: list[str], ts: str, value: str, length: str, step: str | None = None, late: str | None = None) -> DataFrame:
    """``keys, start, n, mean, m2, ptp``: tumbling windows of ``length``, or sliding ones that start every ``step``. On a
    stream, ``late`` is the watermark: rows later than that are dropped, and windows leave in append mode once it has
    passed them. Counts, means and sums of squares are partial aggregates, whatever the rate."""
    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    w = F.window(ts, length, step) if step else F.window(ts, length)
    got = rows.groupBy(*keys, w).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"), (F.max(value) - F.min(value)).alias("ptp")
    )
    return got.select(*keys, F.col("window.start").alias("start"), "n", "mean", "m2", "ptp")


def good_epochs(epochs: DataFrame, least: int, most_ptp: float) -> DataFrame:
    """Windows of enough samples whose peak-to-peak is not above the threshold; a filter, so it streams."""
    return epochs.filter((F.col("n") >= least) & (F.col("ptp") <= most_ptp))


def epoch_summaries(df: DataFrame, keys: list[str], ts: str, value: str, length: str, step: str, least: int, most_ptp: float, span: str, late: str | None = None) -> DataFrame:
    """``keys, start, n_epochs, n, mean, m2`` of the good sliding epochs that end in each ``span``: windows, then their
    rejection, then the merging of their counts, means and sums of squares, as two stateful steps of one stream. The first
    step's windows carry their event time on, so ``late`` is the watermark of both: a span leaves once the watermark has
    passed its end, when every epoch that ends in it has left the first step. State is a row for each key and open window."""
    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    one = rows.groupBy(*keys, F.window(ts, length, step).alias("w")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"), (F.max(value) - F.min(value)).alias("ptp")
    )
    n, mean = F.col("n"), F.col("mean")
    got = good_epochs(one, least, most_ptp).groupBy(*keys, F.window("w", span).alias("s")).agg(
        F.count("*").alias("n_epochs"), F.sum("n").alias("n"), (F.sum(n * mean) / F.sum("n")).alias("mean"), F.sum("m2").alias("m2"), (F.sum(n * mean * mean)).alias("__q")
    )
    return got.select(*keys, F.col("s.start").alias("start"), "n_epochs", "n", "mean", (F.col("m2") + F.greatest(F.col("__q") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))).alias("m2"))


def run_to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    """What is available now, appended to a Parquet folder exactly once; the next call goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
