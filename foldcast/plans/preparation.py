"""From a raw table and its column table to scaled train and valid rows per fold."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.functions.dates import from_excel_day
from foldcast.operators.columns import (
    quoted, remove_columns, reorder_columns, verify_columns,
)
from foldcast.operators.encode import onehot, onehot_range
from foldcast.operators.folds import assign_folds, folds_of_years
from foldcast.operators.impute import fill_mean, fill_values, mask_null_median
from foldcast.operators.ordered import lag_name, lag_rows, longest_key
from foldcast.operators.scale import (
    Stats, group_stats, learn, long_stats, merge_stats, minmax_scaled, numeric_value, present,
    scale_std, std_scaled,
)
from foldcast.plans import metadata as md
from foldcast.plans.metadata import ColumnTable
from foldcast.session import materialise, small_table

log = logging.getLogger(__name__)

LAG_TEMPLATE = "{col}_l{n}"
CHUNK_ROWS = 1_000_000


@dataclass
class Steps:
    """Named intermediate frames of a job, for inspection and tests. They are lazy;
    persist one before reading it often."""

    frames: dict[str, DataFrame] = field(default_factory=dict)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.frames:
            log.warning("step %s is kept twice; the later one stays", name)
        self.frames[name] = df
        return df


@dataclass(frozen=True)
class Prepared:
    """``rows`` carry ``fold`` and ``split``; ``statistics`` has a row per fold and
    column, learnt on the training rows; ``table`` has the new columns."""

    rows: DataFrame
    statistics: DataFrame
    table: ColumnTable
    unmatched: dict[str, list[str]]


def year_of(df: DataFrame, date_column: str) -> Column:
    """The year of a date column, whether dates or spreadsheet day numbers."""
    kind = df.schema[date_column].dataType
    col = quoted(date_column)
    return F.year(from_excel_day(col) if isinstance(kind, T.NumericType) else col)


#: Fixed value: the name of the year column.
YEAR_COLUMN = "x_c_y"


def with_year(df: DataFrame, date_column: str, name: str = YEAR_COLUMN) -> DataFrame:
    """Add the year of the date column, unless the data have a year column already."""
    return df if name in df.columns else df.withColumn(name, year_of(df, date_column))


def lag_features(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int],
    order: Sequence[str],
    keys: Sequence[str] = (),
    normalised: bool = False,
    template: str = LAG_TEMPLATE,
    transformation=None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Row lags whose empty start is filled with the mean of the lagged column, after
    scaling to mean 0 and std 1 if asked for.

    The lagged rows are written once: their means need them all before the fill. A key
    with more than ``chunk_rows`` rows is lagged in chunks.
    """
    names = [lag_name(c, n, template) for c in columns for n in lags]
    if not names:
        return df
    chunks = chunk_rows if longest_key(df, keys) > chunk_rows else None
    lagged = lag_rows(df, columns, lags, order, keys, template, transformation, chunks)
    stored = materialise(lagged, "lags")
    return fill_lags(stored, learn(stored, names), normalised)


def fill_lags(df: DataFrame, stats: dict[str, Stats], normalised: bool = False) -> DataFrame:
    means = {c: s.mean for c, s in stats.items()}
    if not normalised:
        return fill_mean(df, list(stats), means)
    # A scaled column has mean 0; one without values stays null.
    scaled = scale_std(df, list(stats), stats)
    return fill_values(scaled, {c: 0.0 for c, m in means.items() if m is not None})


def before_split(
    df: DataFrame,
    table: ColumnTable,
    lags: Sequence[int] = (),
    keys: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    learn_from: DataFrame | None = None,
) -> tuple[DataFrame, ColumnTable, dict[str, list[str]]]:
    """Check, drop, mask and fill, one-hot, lags.

    Medians and lag means come from the whole table; pass ``learn_from`` to take
    the medians from training rows only. The keys and the date are never filled.
    The rows are written once; what is learnt after that, and all later steps,
    read them from there.
    """
    unmatched = verify_columns(df, [*table.names, *keys])
    if any(unmatched.values()):
        log.warning("columns on one side only: %s", unmatched)
    date = table.date_column()
    df = remove_columns(df, table.with_operation(md.REMOVE))
    fillable = [c for c in df.columns if c not in (*keys, date)]
    df = mask_null_median(df, fillable, learn_from=learn_from)
    df, observed = onehot(df, present(df, table.with_operation(md.ONE_TO_MANY)))
    ranges = {c: r for c, r in table.declared_ranges().items() if c in df.columns}
    df, declared = onehot_range(df, ranges)
    created = observed | declared
    table = table.replace_columns(created)
    if lags:
        chunks = chunk_rows if longest_key(df, keys) > chunk_rows else None
        df = lag_rows(df, table.targets(), lags, [date], keys, LAG_TEMPLATE, None, chunks)
    stored = materialise(df, "pre_split")
    lagged = [lag_name(c, n, LAG_TEMPLATE) for c in table.targets() for n in lags]
    indicators = [n for names in created.values() for n in names]
    if lagged or indicators:
        row = group_stats(stored, [*lagged, *indicators]).head()  # one pass for both
        table = table.updated({c: _as_values(row[c]) for c in indicators})
        stored = fill_mean(stored, lagged, {c: row[c]["mean"] for c in lagged})
    return stored, table.with_lags(lags, LAG_TEMPLATE), unmatched


def _as_values(stats) -> dict[str, float | None]:
    return {
        "mean": stats["mean"], "std": stats["std_samp"], "min": stats["min"], "max": stats["max"]
    }


def indicator_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, sample std, min and max of indicator columns, a row per column."""
    return long_stats(group_stats(df, names), names).select(
        "column", "mean", F.col("std_samp").alias("std"), "min", "max"
    )


def apply_folds(
    df: DataFrame,
    table: ColumnTable,
    train_years: Sequence[int],
    valid_years: int = 1,
    null_scope: str = "split",
) -> tuple[DataFrame, DataFrame]:
    """All folds in one plan: (rows, statistics).

    The year of a row is that of its year column, or else of its date. Statistics are taken
    once per year and merged per fold, so the fit reads each row once. ``null_scope="split"`` fills the nulls of a mean column with the
    mean of the row's own split, ``"train"`` with that of the training rows.
    """
    if null_scope not in ("split", "train"):
        raise ValueError("null_scope must be 'split' or 'train'")
    spark = df.sparkSession
    year = quoted(YEAR_COLUMN).cast("int") if YEAR_COLUMN in df.columns else year_of(df, table.date_column())
    std = present(df, table.normalised(md.STD))
    minmax = present(df, table.normalised(md.MINMAX))
    zero = present(df, table.null_policy(md.ZERO))
    mean = [c for c in present(df, table.null_policy(md.MEAN)) if c not in zero]
    measured = list(dict.fromkeys([*std, *minmax, *mean, *present(df, table.with_statistics())]))
    # Rows per year, then per fold and split: small tables, worked out once.
    yearly = small_table(group_stats(df, measured, [year.cast("int").alias("year")]))
    years = sorted(r.year for r in yearly.select("year").collect() if r.year is not None)
    folds = folds_of_years(spark, years, train_years, valid_years)
    rows = assign_folds(df, folds, year)
    by_split = small_table(
        merge_stats(yearly.join(F.broadcast(folds), "year"), measured, ["fold", "split"])
    )
    train = by_split.where("split = 'train'").drop("split")
    learnt = train.select("fold", *[quoted(c).alias(f"_s_{c}") for c in measured])
    # Few rows per fold and split, so both joins with them are broadcast.
    rows = rows.join(F.broadcast(learnt), "fold")
    if mean and null_scope == "split":
        own = by_split.select(
            "fold", "split", *[quoted(c)["mean"].alias(f"_f_{c}") for c in mean]
        )
        rows = rows.join(F.broadcast(own), ["fold", "split"])

    def value(c: str) -> Column:
        learnt_c = quoted(f"_s_{c}")

        def scaled(x: Column) -> Column:
            if c in std:
                x = std_scaled(x, learnt_c["mean"], learnt_c["std"])
            if c in minmax:
                x = minmax_scaled(x, learnt_c["min"], learnt_c["max"])
            return x

        out = scaled(numeric_value(df, c)) if c in std or c in minmax else quoted(c)
        if c in mean:
            fill = quoted(f"_f_{c}") if null_scope == "split" else learnt_c["mean"]
            out = F.coalesce(out, scaled(fill))
        if c in zero:
            out = F.coalesce(out, F.lit(0))
        return out.alias(c)

    touched = {*std, *minmax, *mean, *zero}
    rows = rows.select(
        "fold", "split", *[value(c) if c in touched else quoted(c) for c in df.columns]
    )
    return rows, long_stats(train, measured)


def prepare_folds(
    df: DataFrame,
    table: ColumnTable,
    train_years: Sequence[int],
    valid_years: int = 1,
    lags: Sequence[int] = (),
    keys: Sequence[str] = (),
    null_scope: str = "split",
    steps: Steps | None = None,
    chunk_rows: int = CHUNK_ROWS,
    learn_from: DataFrame | None = None,
) -> Prepared:
    """The whole preparation. It reads ``df`` a few times to learn medians and
    categories, so pass a table, or the result of ``materialise``."""
    steps = steps or Steps()
    ready, table, unmatched = before_split(df, table, lags, keys, chunk_rows, learn_from)
    steps.keep("pre_split", ready)
    rows, statistics = apply_folds(ready, table, train_years, valid_years, null_scope)
    rows = reorder_columns(
        rows,
        targets=[c for c in table.targets() if c in rows.columns],
        batch=["fold", "split", *table.with_operation(md.BATCH)],
        date=[table.date_column()],
        target_masks=[c for c in table.with_operation(md.TARGET_MASK) if c in rows.columns],
    )
    return Prepared(steps.keep("post_split", rows), statistics, table, unmatched)


def learnt_of_fold(statistics: DataFrame, fold: int) -> dict[str, Stats]:
    """The statistics of one fold as literals, for a stream or a later batch."""
    rows = statistics.where(F.col("fold") == fold).collect()  # a row per column
    return {r["column"]: Stats(r["mean"], r["std"], r["min"], r["max"]) for r in rows}
