"""Statistics per key that are kept up to date as rows arrive."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.operators.columns import quoted
from foldcast.operators.scale import merge_moments, moments


@dataclass(frozen=True)
class MomentStore:
    """Moments of ``columns`` per key of all rows seen so far, a part per batch of rows.

    ``add`` scans the new rows only and writes their keys only; nothing stored is read or
    rewritten. ``read`` merges the parts of a key, of which there are as many as batches that
    hold it. ``compact`` merges them for good.
    """

    path: str
    keys: Sequence[str]
    columns: Sequence[str]

    def add(self, df: DataFrame, batch: Column) -> None:
        """Take in new rows. A batch that is there already is replaced, so a repeated call
        counts no row twice; a null batch is one of its own."""
        named = df.withColumn("_batch", batch.cast("string"))
        self._write(moments(named, self.columns, [*self.keys, "_batch"]))

    def _write(self, parts: DataFrame) -> None:
        # Only the batches in ``parts`` are replaced.
        (
            parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("_batch").parquet(self.path)
        )

    def _parts(self, spark: SparkSession) -> DataFrame:
        parts = spark.read.parquet(self.path)
        return parts.withColumn("_batch", F.col("_batch").cast("string"))

    def read(self, spark: SparkSession) -> DataFrame:
        """(keys, column, n, mean, std, std_samp, min, max) over all batches."""
        whole = merge_moments(self._parts(spark), [*self.keys, "column"], ["_batch"])
        spread = F.col("m2") / F.nullif(F.col("n"), F.lit(0))
        sample = F.when(F.col("n") > 1, F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0)))
        return whole.select(
            *map(quoted, self.keys), "column", "n", "mean", F.sqrt(spread).alias("std"),
            F.sqrt(sample).alias("std_samp"), "min", "max",
        )

    def compact(self, spark: SparkSession, path: str, batch: str) -> MomentStore:
        """A store at ``path`` that holds all batches as the one named ``batch``."""
        whole = merge_moments(self._parts(spark), [*self.keys, "column"], ["_batch"])
        store = MomentStore(path, self.keys, self.columns)
        store._write(whole.withColumn("_batch", F.lit(batch)))
        return store
