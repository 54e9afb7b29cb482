"""Scaling with statistics that are learnt once and applied anywhere.

Statistics are held as one row per group with a struct per column. Those of a
fold are merged from those of its years, so rows are read once however many
folds contain them.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldcast.operators.columns import is_numeric, quoted
from foldcast.operators.joins import join_on

log = logging.getLogger(__name__)

MINMAX_RANGE = (-1.0, 1.0)  # fixed value


@dataclass(frozen=True)
class Stats:
    """Learnt statistics of one column; ``std`` is the population value."""

    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None


def numeric_value(df: DataFrame, name: str) -> Column:
    """The column as a double; what is not a number becomes null."""
    col = quoted(name)
    value = col.cast("double") if is_numeric(df, name) else col.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        log.warning("columns not in the data: %s", absent)
    return [c for c in columns if c in df.columns]


def group_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str | Column] = ()) -> DataFrame:
    """Per group: struct (n, mean, std, std_samp, min, max) per column."""
    if not columns:
        return df.select(*by).distinct()
    return df.groupBy(*by).agg(
        *[
            F.struct(
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_pop(x).alias("std"),
                F.stddev_samp(x).alias("std_samp"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            ).alias(c)
            for c in columns
            for x in [numeric_value(df, c)]
        ]
    )


def merge_stats(stats: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Statistics of larger groups from those of their parts (small tables)."""
    if not columns:
        return stats.select(*by).distinct()
    whole = Window.partitionBy(*by)
    n = {c: quoted(c)["n"] for c in columns}
    mean = {c: F.sum(n[c] * quoted(c)["mean"]).over(whole) / F.nullif(F.sum(n[c]).over(whole), F.lit(0))
            for c in columns}
    centred = stats.withColumns({f"_m_{c}": mean[c] for c in columns})
    aggs = []
    for c in columns:
        part, centre = quoted(c), F.first(quoted(f"_m_{c}"))
        gap = part["mean"] - quoted(f"_m_{c}")
        squares = F.sum(part["n"] * (part["std"] * part["std"] + gap * gap))
        total = F.sum(part["n"])
        aggs.append(
            F.struct(
                total.alias("n"),
                centre.alias("mean"),
                F.sqrt(squares / F.nullif(total, F.lit(0))).alias("std"),
                F.when(total > 1, F.sqrt(squares / F.nullif(total - 1, F.lit(0)))).alias("std_samp"),
                F.min(part["min"]).alias("min"),
                F.max(part["max"]).alias("max"),
            ).alias(c)
        )
    return centred.groupBy(*by).agg(*aggs)


def long_stats(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per group and column."""
    by = [c for c in stats.columns if c not in columns]
    if not columns:
        return stats.select(*by, F.lit(None).cast("string").alias("column")).limit(0)
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), quoted(c).alias("s")) for c in columns]
    )
    return stats.select(*by, F.explode(rows).alias("_e")).select(*by, "_e.column", "_e.s.*")


def learn(df: DataFrame, columns: Sequence[str]) -> dict[str, Stats]:
    """Statistics of all columns in one aggregate, brought to the driver."""
    names = present(df, columns)
    if not names:
        return {}
    row = group_stats(df, names).head()
    return {
        c: Stats(row[i]["mean"], row[i]["std"], row[i]["min"], row[i]["max"])
        for i, c in enumerate(names)
    }


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("double")


def std_scaled(x: Column, mean, std) -> Column:
    """A null mean counts as 0; a null or zero std counts as 1."""
    deviation = F.coalesce(F.nullif(_lit(std), F.lit(0.0)), F.lit(1.0))
    return (x - F.coalesce(_lit(mean), F.lit(0.0))) / deviation


def minmax_scaled(x: Column, low, high, to: tuple[float, float] = MINMAX_RANGE) -> Column:
    """A zero range counts as 1; values beyond the learnt range are not clipped."""
    span = F.coalesce(F.nullif(_lit(high) - _lit(low), F.lit(0.0)), F.lit(1.0))
    return F.lit(float(to[0])) + (x - _lit(low)) * F.lit(float(to[1] - to[0])) / span


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def scale_std(
    df: DataFrame, columns: Sequence[str], learnt: Mapping[str, Stats] | None = None
) -> DataFrame:
    """(x - mean) / std, learnt from ``df`` unless given by column name."""
    names = present(df, columns)
    stats = learn(df, names) if learnt is None else learnt
    _require_stats(names, stats)
    return _replace(
        df, {c: std_scaled(numeric_value(df, c), stats[c].mean, stats[c].std) for c in names}
    )


def scale_minmax(
    df: DataFrame,
    columns: Sequence[str],
    learnt: Mapping[str, Stats] | None = None,
    to: tuple[float, float] = MINMAX_RANGE,
) -> DataFrame:
    names = present(df, columns)
    stats = learn(df, names) if learnt is None else learnt
    _require_stats(names, stats)
    return _replace(
        df, {c: minmax_scaled(numeric_value(df, c), stats[c].min, stats[c].max, to) for c in names}
    )


def _require_stats(names: Sequence[str], stats: Mapping[str, Stats]) -> None:
    absent = [c for c in names if c not in stats]
    if absent:
        raise ValueError(f"no learnt statistics for columns: {absent}")


def scale_by_group(
    df: DataFrame,
    stats: DataFrame,
    by: Sequence[str],
    std: Sequence[str] = (),
    minmax: Sequence[str] = (),
    to: tuple[float, float] = MINMAX_RANGE,
) -> DataFrame:
    """Scale each row with the statistics of its group, as from ``group_stats`` or
    ``merge_stats``. Spark broadcasts the statistics when they are small."""
    names = [*std, *minmax]
    right = stats.select(*by, *[quoted(c).alias(f"_s_{c}") for c in names])
    joined = join_on(df, right, list(by), "left")
    new = {c: std_scaled(numeric_value(df, c), quoted(f"_s_{c}")["mean"], quoted(f"_s_{c}")["std"])
           for c in std}
    new |= {
        c: minmax_scaled(numeric_value(df, c), quoted(f"_s_{c}")["min"], quoted(f"_s_{c}")["max"], to)
        for c in minmax
    }
    return joined.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def upsert_stats(
    stored: DataFrame, fresh: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """A statistics table kept up to date: a fresh value wins where it is set, other
    values and rows stay, new rows are added."""
    values = [c for c in stored.columns if c not in keys]
    new = fresh.select(
        *keys, *[quoted(c).alias(f"_new_{c}") for c in values if c in fresh.columns]
    )
    return join_on(stored, new, list(keys), "full_outer").select(
        *keys,
        *[
            F.coalesce(quoted(f"_new_{c}"), quoted(c)).alias(c) if c in fresh.columns else quoted(c)
            for c in values
        ],
    )


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str | Column] = ()) -> DataFrame:
    """Per group and column, in one scan: n, mean, m2 (sum of squares around the mean), min
    and max. Unlike a std these can be merged; see ``merge_moments``."""
    stats = long_stats(group_stats(df, columns, by), columns)
    return stats.withColumn("m2", F.col("std") * F.col("std") * F.col("n")).drop("std", "std_samp")


def merge_moments(parts: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Moments of groups from those of their parts, one row per part and group. The parts of a
    group are merged in ``order``, so the result is the same in every run."""
    values = ["n", "mean", "m2", "min", "max"]
    zero = F.struct(
        F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast("double").alias(v) for v in values[1:]]
    )

    def merged(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        old = F.coalesce(a["mean"], b["mean"])
        gap = b["mean"] - old
        return F.struct(
            n.alias("n"),
            (old + gap * b["n"] / n).alias("mean"),
            (F.coalesce(a["m2"], F.lit(0.0)) + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
            F.least(a["min"], b["min"]).alias("min"),
            F.greatest(a["max"], b["max"]).alias("max"),
        )

    part = F.struct(*[quoted(o) for o in order], *values)
    return (
        parts.groupBy(*map(quoted, by)).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
        .withColumn("_parts", F.filter("_parts", lambda x: x["n"] > 0))
        .select(*map(quoted, by), F.reduce("_parts", zero, merged).alias("_all"))
        .select(*map(quoted, by), "_all.*")
    )
