"""Calendar lags and running means on series with one row per key and day.

Reduce raw rows with ``daily_series`` first: it combines before the shuffle, and
a key then has at most one row per calendar day, which bounds the windows here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldcast.operators.columns import quoted
from foldcast.operators.joins import join_on


def daily_series(
    df: DataFrame, day: Column, measures: Mapping[str, Column], keys: Sequence[str | Column] = ()
) -> DataFrame:
    """One row per key and day. ``measures`` are aggregates by name."""
    return df.groupBy(*keys, day.alias("d")).agg(*[m.alias(n) for n, m in measures.items()])


def _by_day(day: str, keys: Sequence[str]):
    return Window.partitionBy(*map(quoted, keys)).orderBy(F.unix_date(quoted(day)))


def day_lag(column: Column, lag: int, day: str, keys: Sequence[str] = ()) -> Column:
    """The value ``lag`` calendar days earlier, null where that day is missing or the row
    has no day."""
    earlier = F.max(column).over(_by_day(day, keys).rangeBetween(-lag, -lag))
    return F.when(quoted(day).isNotNull(), earlier)


def lag_days(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int],
    day: str,
    keys: Sequence[str] = (),
    template: str = "{col}_d{n}",
) -> DataFrame:
    """Calendar lags of all columns; they share one shuffle and one sort."""
    return df.withColumns(
        {
            template.format(col=c, n=n): day_lag(quoted(c), n, day, keys)
            for c in columns
            for n in lags
        }
    )


def lag_days_joined(
    df: DataFrame,
    columns: Sequence[str],
    lag: int,
    day: str,
    keys: Sequence[str] = (),
    template: str = "{col}_d{n}",
) -> DataFrame:
    """One calendar lag as an equi-join on key and day, where keys are few and the
    join should spread over days as well."""
    earlier = df.where(quoted(day).isNotNull()).select(
        *keys,
        F.date_add(quoted(day), lag).alias(day),
        *[quoted(c).alias(template.format(col=c, n=lag)) for c in columns],
    )
    return join_on(df, earlier, [*keys, day], "left")


def running_mean(
    value: Column, day: str, keys: Sequence[str] = (), mask: Column | None = None
) -> Column:
    """Mean of the earlier values whose mask is 0; the row itself is not used."""
    counted = value if mask is None else F.when(mask == 0, value)
    window = _by_day(day, keys).rowsBetween(Window.unboundedPreceding, -1)
    return F.avg(counted).over(window)


def lagged_pairs(
    df: DataFrame, column: str, lags: Sequence[int], day: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, day, lag, y, p): each value beside the one ``lag`` calendar days before,
    null where that day is missing. One equi-join serves all lags."""
    wanted = df.select(
        *keys,
        day,
        quoted(column).cast("double").alias("y"),
        F.explode(F.array(*[F.lit(int(n)) for n in lags])).alias("lag"),
    ).withColumn("_source", F.date_sub(quoted(day), F.col("lag")))
    source = df.where(quoted(day).isNotNull()).select(
        *keys, quoted(day).alias("_source"), quoted(column).cast("double").alias("p")
    )
    return join_on(wanted, source, [*keys, "_source"], "left").drop("_source")


def long_series(
    df: DataFrame, day: str, series: Mapping[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, day, series, value): one row per day and named series, without the days on
    which a series has no value. A prediction on the log scale is passed as ``exp`` of
    its column, once."""
    entries = [
        F.struct(F.lit(name).alias("series"), value.cast("double").alias("value"))
        for name, value in series.items()
    ]
    return df.select(*keys, day, F.inline(F.array(*entries))).where("value is not null")
