"""Where a run's tables lie: partition columns in place of file names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.operators.columns import quoted

# Fixed value: the columns of a stored score.
SCORE_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("features", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def lags_tag(lags: Sequence[int]) -> str:
    return "x".join(map(str, lags)) if lags else "none"


# What tells one prepared data set from another.
PREPARED = ["dataset", "lags_tag", "valid_years"]


def _tags(dataset: str, lags: Sequence[int], valid_years: int) -> dict[str, Column]:
    return dict(zip(PREPARED, map(F.lit, (dataset, lags_tag(lags), str(valid_years)))))


@dataclass(frozen=True)
class RunLayout:
    """Tables of all runs below one base path."""

    base: str

    @property
    def folds(self) -> str:
        return f"{self.base.rstrip('/')}/folds"

    @property
    def statistics(self) -> str:
        return f"{self.base.rstrip('/')}/statistics"

    @property
    def scores(self) -> str:
        return f"{self.base.rstrip('/')}/scores"

    @property
    def predictions(self) -> str:
        return f"{self.base.rstrip('/')}/predictions"

    def columns(self, dataset: str, lags: Sequence[int] = (), valid_years: int = 1) -> str:
        return (
            f"{self.base.rstrip('/')}/columns/dataset={dataset}/lags_tag={lags_tag(lags)}"
            f"/valid_years={valid_years}"
        )

    def model(self, dataset: str, fold: int, run: str) -> str:
        return f"{self.base.rstrip('/')}/models/dataset={dataset}/fold={fold}/run={run}"

    def _write(self, df: DataFrame, path: str, parts: Sequence[str]) -> None:
        # Only the partitions in ``df`` are replaced, so one fold can be rewritten.
        (
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts).parquet(path)
        )

    def write_folds(
        self, df: DataFrame, dataset: str, lags: Sequence[int] = (), sort: Sequence[str] = (),
        valid_years: int = 1,
    ) -> None:
        """Rows with ``fold`` and ``split``, spread so that a large fold makes many
        files, each sorted."""
        tagged = df.withColumns(_tags(dataset, lags, valid_years))
        order = [quoted(c) for c in sort if c in df.columns]
        # The row hash splits a fold whose sort columns do not.
        spread = tagged.repartitionByRange(
            "fold", "split", *order, F.xxhash64(*[quoted(c) for c in df.columns])
        ).sortWithinPartitions("fold", "split", *order)
        self._write(spread, self.folds, [*PREPARED, "fold", "split"])

    def read_folds(
        self, spark: SparkSession, dataset: str, lags: Sequence[int] = (),
        fold: int | None = None, split: str | None = None, valid_years: int = 1,
    ) -> DataFrame:
        df = spark.read.parquet(self.folds)
        for name, value in _tags(dataset, lags, valid_years).items():
            df = df.where(F.col(name).cast("string") == value)  # folder names may look like numbers
        if fold is not None:
            df = df.where(F.col("fold") == fold)
        if split is not None:
            df = df.where(F.col("split") == split)
        return df

    def write_statistics(
        self, stats: DataFrame, dataset: str, lags: Sequence[int] = (), valid_years: int = 1
    ) -> None:
        self._write(
            stats.withColumns(_tags(dataset, lags, valid_years)).coalesce(1),  # a row per fold and column
            self.statistics, [*PREPARED, "fold"],
        )

    def write_predictions(self, predictions: DataFrame) -> None:
        """Rows with ``dataset``, ``run``, ``fold`` and ``split``; a run written again replaces
        its folds."""
        self._write(predictions, self.predictions, ["dataset", "run", "fold", "split"])

    def write_scores(self, scores: DataFrame) -> None:
        """Score rows, absent columns null; a run written again replaces its folds."""
        full = scores.select(
            *[
                (F.col(f.name) if f.name in scores.columns else F.lit(None))
                .cast(f.dataType).alias(f.name)
                for f in SCORE_SCHEMA.fields
            ]
        )
        self._write(full, self.scores, ["dataset", "run", "fold"])
