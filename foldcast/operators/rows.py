"""Row level steps: splits by value, date windows, gaps in the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldcast.functions.dates import day_range
from foldcast.operators.columns import quoted
from foldcast.operators.joins import join_on


def split_by_values(
    df: DataFrame, column: str, values: Sequence | DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is listed, and all the others; a null is in the others.

    A Python list becomes a filter that reaches the scan. A one-column DataFrame
    of values of any size becomes a semi join and an anti join.
    """
    if isinstance(values, DataFrame):
        key = values.columns[0]
        listed = values.select(quoted(key).alias("_listed"))
        condition = quoted(column) == F.col("_listed")
        return df.join(listed, condition, "left_semi"), df.join(listed, condition, "left_anti")
    inside = quoted(column).isin(list(values))
    return df.where(inside), df.where(F.coalesce(~inside, F.lit(True)))


def rows_of_years(df: DataFrame, year: Column, years: Sequence[int]) -> DataFrame:
    return df.where(year.isin(list(years)))


def between_days(
    df: DataFrame, day: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Rows within the given days; an open end keeps all rows on that side."""
    if first is not None:
        df = df.where(quoted(day) >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(quoted(day) <= F.lit(last).cast("date"))
    return df


def calendar(df: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last day in the data, per key."""
    extent = df.groupBy(*keys).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    return extent.where(F.col("_first").isNotNull()).select(
        *keys, F.explode(day_range(F.col("_first"), F.col("_last"))).alias(day)
    )


def missing_days(df: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Days between the first and the last that the data lacks, per key."""
    present = df.select(*keys, day).distinct()
    return join_on(calendar(present, day, keys), present, [*keys, day], "left_anti")


def day_continuity(
    df: DataFrame, day: str, keys: Sequence[str] = (), count: str | None = None
) -> DataFrame:
    """Per key: rows, first and last day, gaps and repeats, and whether the days
    run without either. Counts per (key, day) come first, so the window holds at
    most one row per calendar day whatever the size of the data. ``count`` names a
    column that says how many rows an already counted row stands for."""
    rows = F.count(F.lit(1)) if count is None else F.sum(count)
    per_day = df.groupBy(*keys, day).agg(rows.alias("_rows"))
    step = F.datediff(F.col(day), F.lag(day).over(Window.partitionBy(*keys).orderBy(day)))
    out = (
        per_day.withColumn("_step", step)
        .groupBy(*keys)
        .agg(
            F.sum("_rows").cast("bigint").alias("n_rows"),
            F.min(day).alias("first_day"),
            F.max(day).alias("last_day"),
            F.sum(F.coalesce(F.col("_step") - 1, F.lit(0))).cast("bigint").alias("n_missing"),
            F.sum(F.col("_rows") - 1).cast("bigint").alias("n_repeated"),
        )
    )
    return out.withColumn(
        "consecutive", (F.col("n_missing") == 0) & (F.col("n_repeated") == 0)
    )
