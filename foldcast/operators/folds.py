"""Expanding-window folds by year, ordered and random splits, shuffled copies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.functions.sampling import key_hash
from foldcast.operators.columns import quoted
from foldcast.operators.joins import join_on
from foldcast.operators.ordered import dense_index
from foldcast.operators.ranks import at_or_after_rank
from foldcast.session import checked_broadcast


def years_present(df: DataFrame, year: Column) -> list[int]:
    """The calendar years in the data, in order (one scan of one column)."""
    rows = df.select(year.cast("int").alias("year")).where("year is not null").distinct()
    return sorted(r.year for r in rows.collect())


def folds_of_years(
    spark: SparkSession, years: Sequence[int], train_years: Sequence[int], valid_years: int = 1
) -> DataFrame:
    """(fold, split, year, complete): fold n trains on the first n years and is
    validated on the next ``valid_years``. ``complete`` is false where the years end
    before that. The table has a few rows per fold."""
    rows = []
    for n in train_years:
        used = [("train", y) for y in years[:n]] + [("valid", y) for y in years[n:n + valid_years]]
        complete = len(years) >= n + valid_years
        rows += [(int(n), split, int(y), complete) for split, y in used]
    return spark.createDataFrame(rows, "fold int, split string, year int, complete boolean")


def fold_table(
    df: DataFrame, year: Column, train_years: Sequence[int], valid_years: int = 1
) -> DataFrame:
    """``folds_of_years`` for the years in the data."""
    return folds_of_years(df.sparkSession, years_present(df, year), train_years, valid_years)


def assign_folds(df: DataFrame, folds: DataFrame, year: Column) -> DataFrame:
    """Each row once per fold that contains it. The fold table holds a handful of
    rows per fold whatever the data, so it is always broadcast."""
    right = folds.select("fold", "split", F.col("year").alias("_year"))
    return df.join(F.broadcast(right), year.cast("int") == F.col("_year")).drop("_year")


def fold_day_check(df: DataFrame, folds: DataFrame, day: str, count: str | None = None) -> DataFrame:
    """Per fold and split: its days and rows, and how many days its whole calendar years have, from
    the first of January of its first year on, so that a fold without its first or last days, or
    without a year in between, is found. ``count`` names a column that says how many rows an
    already counted row stands for. Rows without a day belong to no fold."""
    rows = F.count(F.lit(1)) if count is None else F.sum(count)
    per_day = df.groupBy(day).agg(rows.alias("_rows"))
    present = assign_folds(per_day, folds, F.year(day)).groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("_days"), F.sum("_rows").cast("bigint").alias("_all")
    )
    start, end = (F.make_date(year, F.lit(1), F.lit(1)) for year in (F.min("year"), F.max("year") + 1))
    expected = folds.groupBy("fold", "split").agg(F.datediff(end, start).cast("bigint").alias("n_expected"))
    n_days = F.coalesce("_days", F.lit(0))
    return expected.join(present, ["fold", "split"], "left").select(
        "fold", "split", n_days.cast("bigint").alias("n_days"), F.coalesce("_all", F.lit(0)).cast("bigint").alias("n_rows"),
        "n_expected", (n_days == F.col("n_expected")).alias("complete"),
    )


def _labelled(df: DataFrame, is_late: Column, take_from_end: bool) -> DataFrame:
    early, late = ("train", "test") if take_from_end else ("test", "train")
    return df.withColumn("split", F.when(is_late, F.lit(late)).otherwise(F.lit(early)))


def _boundary(n: int, test_size: float, take_from_end: bool) -> int:
    test = math.ceil(n * test_size)
    return n - test if take_from_end else test


def _split_at(
    df: DataFrame, order: Sequence[str | Column], test_size: float, take_from_end: bool
) -> DataFrame:
    if not isinstance(test_size, float) or not 0.0 <= test_size <= 1.0:
        raise ValueError("test_size must be a float between 0 and 1")
    n = df.count()
    rank = _boundary(n, test_size, take_from_end)
    if rank == 0 or rank >= n:
        return _labelled(df, F.lit(rank == 0), take_from_end)
    return _labelled(df, at_or_after_rank(df, order, rank, n), take_from_end)


def ordered_split(
    df: DataFrame,
    order: Sequence[str],
    test_size: float,
    take_from_end: bool = True,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Label rows train or test by position; exactly ceil(n * test_size) are test.

    Without keys only the boundary row is looked up and the split is a filter on
    the order columns. With keys each key is split by itself.
    """
    if not keys:
        return _split_at(df, order, test_size, take_from_end)
    indexed = dense_index(df, order, keys, "_idx")
    sizes = indexed.groupBy(*map(quoted, keys)).agg((F.max("_idx") + 1).alias("_n"))
    test = F.ceil(F.col("_n") * F.lit(test_size))
    start = F.col("_n") - test if take_from_end else test
    sized = join_on(indexed, checked_broadcast(sizes, "sizes"), keys)
    labelled = _labelled(sized, F.col("_idx") >= start, take_from_end)
    return labelled.select(*[quoted(c) for c in df.columns], "split")


def random_split(
    df: DataFrame, keys: Sequence[str], test_size: float, seed: int = 42
) -> DataFrame:
    """Random labels of exact size, fixed by the row's key and the seed, so that
    they are the same under any partitioning."""
    return _split_at(df, [key_hash(keys, seed), *keys], test_size, True)


def shuffled_copies(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    seed: int = 42,
    within: Sequence[str] = (),
) -> DataFrame:
    """Per column an independent random permutation ``<col>_fake`` of its values, as
    a control for feature importance: row k in key order gets the value of row k in
    hash order. ``within`` keeps each permutation inside its group; the keys must
    identify a row there."""
    place = [*within, "_own"]
    identity = [k for k in keys if k not in within]
    out = dense_index(df, identity, within, "_own")
    for column in columns:
        hashed = df.select(
            *[quoted(c) for c in [*within, *identity]],
            key_hash([quoted(c) for c in [*within, *identity]], f"{seed}{column}").alias("_hash"),
            quoted(column).alias(f"{column}_fake"),
        )
        drawn = dense_index(hashed, ["_hash", *identity], within, "_own").select(
            *[quoted(c) for c in place], quoted(f"{column}_fake")
        )
        out = join_on(out, drawn, place)
    names = [*df.columns, *[f"{c}_fake" for c in columns]]
    return out.select(*[quoted(n) for n in names])
