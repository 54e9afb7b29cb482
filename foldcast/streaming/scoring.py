"""Scores and learnt scaling on streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.metrics import SCORES, Metric, score_columns
from foldcast.operators.encode import onehot_range
from foldcast.operators.scale import Stats, scale_minmax, scale_std
from foldcast.session import fresh_path


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Event time must be a timestamp with a zone before a watermark can use it."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed_scores(
    stream: DataFrame,
    time: str,
    y: Column,
    p: Column,
    by: Sequence[str] = (),
    width: str = "1 day",
    late: str = "1 hour",
    metrics: Mapping[str, Metric] = SCORES,
) -> DataFrame:
    """Scores per tumbling window and group. Partial sums are combined before the
    shuffle; the watermark bounds the state to the open windows."""
    return (
        event_time(stream, time)
        .withWatermark(time, late)
        .groupBy(F.window(time, width), *by)
        .agg(
            F.count(F.when(p.isNotNull(), y)).cast("bigint").alias("n"),
            *score_columns(y, p, metrics),
        )
        .select(F.col("window.start").alias("window_start"), *by, "n", *metrics)
    )


def learnt_features(
    stream: DataFrame,
    std: Mapping[str, Stats] | None = None,
    minmax: Mapping[str, Stats] | None = None,
    ranges: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """The batch scaling and range one-hot, row by row without state."""
    out = scale_std(stream, list(std), std) if std else stream
    out = scale_minmax(out, list(minmax), minmax) if minmax else out
    return onehot_range(out, ranges)[0] if ranges else out


def run_available(
    stream: DataFrame, label: str, timeout: int | None = None, folder: str | None = None,
    progress: list | None = None,
) -> DataFrame:
    """Process what is there now into a table and read it.

    The file sink logs each batch it has written, and the checkpoint the rows it has read, its watermark and
    its state, so each result is written once, also when a task, an executor or the driver
    is lost. With a ``folder`` of the caller, ``table`` and ``progress`` lie there: a later run of the
    same query, in any process, goes on behind the last finished batch, redoes one that was cut
    off, and returns the results of all runs. Without one a fresh folder is taken, for this run only.
    ``progress`` gets Spark's report of every batch.
    """
    spark = stream.sparkSession
    path = folder.rstrip("/") if folder else fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"the stream {label} did not finish in {timeout} s")
    finally:
        if progress is not None:
            progress += query.recentProgress
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
