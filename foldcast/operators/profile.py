"""Column statistics, each set in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.operators.columns import quoted

#: Distinct values that may be listed on the driver.
MOST_VALUES = 10_000


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the nulls of each column and their sum as ``total``."""
    names = list(columns or df.columns)
    counted = df.agg(
        *[F.count_if(quoted(c).isNull()).cast("bigint").alias(c) for c in names]
    )
    total = F.lit(0).cast("bigint")
    for c in names:
        total = total + quoted(c)
    return counted.withColumn("total", total)


def _exact_text(df: DataFrame, column: str) -> Column:
    """The value as text that is equal for equal values of any type; adding 0 makes one of
    both zeros of a floating-point column."""
    floating = isinstance(df.schema[column].dataType, T.FractionalType)
    return (quoted(column) + F.lit(0) if floating else quoted(column)).cast("string")


def _long(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), _exact_text(df, c).alias("value"))
                for c in columns
            ]
        )
    )


def column_profile(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Per column: mean, sample std, min, max, distinct non-null values, nulls.

    The moments come from one aggregate over the columns. Exact distinct counts
    come from (column, value) pairs that are combined before the shuffle, so no
    task sees all values of one column. ``exact=False`` estimates them in the
    first aggregate.
    """
    stats = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.avg(quoted(c)).alias("mean"),
                F.stddev_samp(quoted(c)).alias("std"),
                F.min(quoted(c)).cast("double").alias("min"),
                F.max(quoted(c)).cast("double").alias("max"),
                F.count_if(quoted(c).isNull()).cast("bigint").alias("nan_values"),
                (F.lit(None).cast("bigint") if exact
                 else F.approx_count_distinct(quoted(c)).cast("bigint")).alias("cardinality"),
            )
            for c in columns
        ]
    )
    profile = df.agg(stats.alias("_stats")).select(F.inline("_stats"))
    if not exact:
        return profile
    pairs = df.select(_long(df, columns).alias("_e")).select("_e.*").distinct()
    distinct = pairs.groupBy("column").agg(F.count("value").cast("bigint").alias("cardinality"))
    return (
        profile.drop("cardinality")
        .join(distinct, "column", "left")
        .withColumn("cardinality", F.coalesce("cardinality", F.lit(0).cast("bigint")))
    )


def distinct_values(df: DataFrame, column: str, cap: int = MOST_VALUES) -> list:
    """All distinct non-null values in ascending order.

    More than ``cap`` is an error that names the column, never a shortened list; no more
    than that reach the driver.
    """
    found = df.select(quoted(column).alias("v")).where("v is not null").distinct()
    rows = found.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"column {column} has more than {cap} distinct values")
    return sorted(r.v for r in rows)


def dataset_stats(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(target).alias("mean"), F.stddev_samp(target).alias("std")
    )


def day_extent(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
