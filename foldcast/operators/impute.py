"""Null masks and null replacement.

A fill value that must be learnt is one small aggregate; applying it is a plain
projection, so learnt values can come from another table or an earlier run.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.operators.columns import MASK_SUFFIX, is_numeric, quoted
from foldcast.operators.ranks import SMALL, exact_medians

log = logging.getLogger(__name__)


def count_nulls(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows, and nulls per column, in one pass."""
    if not columns:
        return 0, {}
    row = df.agg(F.count(F.lit(1)), *[F.count_if(quoted(c).isNull()) for c in columns]).head()
    return row[0], {c: row[i + 1] for i, c in enumerate(columns)}


def _masked(
    df: DataFrame, masked: Sequence[str], fills: Mapping[str, object], suffix: str
) -> DataFrame:
    out = [
        F.coalesce(quoted(c), F.lit(fills[c])).alias(c) if c in fills else quoted(c)
        for c in df.columns
        if not (c.endswith(suffix) and c[: -len(suffix)] in masked)
    ]
    out += [quoted(c).isNull().cast("int").alias(c + suffix) for c in masked]
    return df.select(*out)


def mask_nulls(
    df: DataFrame, columns: Sequence[str] | None = None, suffix: str = MASK_SUFFIX
) -> DataFrame:
    """A 0/1 column beside each column that has a null; the nulls stay."""
    _, nulls = count_nulls(df, list(columns or df.columns))
    return _masked(df, [c for c, n in nulls.items() if n], {}, suffix)


def learn_medians(
    df: DataFrame,
    columns: Sequence[str],
    exact: bool = True,
    small: int = SMALL,
    counts: Mapping[str, int] | None = None,
) -> dict[str, float]:
    numeric = [c for c in columns if is_numeric(df, c)]
    if exact:
        return exact_medians(df, numeric, small, counts)
    if not numeric:
        return {}
    row = df.agg(*[F.percentile_approx(quoted(c).cast("double"), 0.5) for c in numeric]).head()
    return {c: row[i] for i, c in enumerate(numeric) if row[i] is not None}


def mask_null_median(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    suffix: str = MASK_SUFFIX,
    exact: bool = True,
    learn_from: DataFrame | None = None,
) -> DataFrame:
    """Mask columns that have nulls and fill the numeric ones with their median.

    Text columns get the mask only. ``learn_from`` takes the medians from other
    rows, such as the training rows.
    """
    total, nulls = count_nulls(df, list(columns or df.columns))
    masked = [c for c, n in nulls.items() if n]
    log.info("nulls before the median fill: %d", sum(nulls.values()))
    if learn_from is None:
        medians = learn_medians(df, masked, exact, counts={c: total - nulls[c] for c in masked})
    else:
        medians = learn_medians(learn_from, masked, exact)
    # An integer column becomes double, since its median may lie between two values.
    return _masked(df, masked, medians, suffix)


def _present(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = list(columns) if columns is not None else df.columns
    absent = [c for c in names if c not in df.columns]
    if absent:
        log.warning("columns not in the data: %s", absent)
    return [c for c in names if c in df.columns]


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls by literals; a null literal leaves its column as it is."""
    values = {c: v for c, v in values.items() if v is not None and c in df.columns}
    if not values:
        return df
    return df.select(
        *[
            F.coalesce(quoted(c), F.lit(values[c])).alias(c) if c in values else quoted(c)
            for c in df.columns
        ]
    )


def fill_nulls(
    df: DataFrame,
    aggregate: Callable[[Column], Column],
    columns: Sequence[str] | None = None,
    learnt: Mapping[str, object] | None = None,
) -> DataFrame:
    """Fill with a learnt value where one is given, else with any aggregate of the
    column, all of them taken in one pass."""
    learnt = {c: v for c, v in (learnt or {}).items() if v is not None}
    names = _present(df, columns)
    unknown = [c for c in names if c not in learnt]
    values = {c: learnt[c] for c in names if c in learnt}
    if unknown:
        row = df.agg(*[aggregate(quoted(c)) for c in unknown]).head()
        values.update({c: row[i] for i, c in enumerate(unknown)})
    return fill_values(df, values)


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    numeric = [c for c in _present(df, columns) if is_numeric(df, c)]
    return fill_values(df, {c: 0 for c in numeric})


def fill_mean(df: DataFrame, columns=None, learnt=None) -> DataFrame:
    return fill_nulls(df, F.avg, columns, learnt)


def fill_min(df: DataFrame, columns=None, learnt=None) -> DataFrame:
    return fill_nulls(df, F.min, columns, learnt)


def null_policy(
    df: DataFrame,
    zero: Sequence[str],
    mean: Sequence[str],
    learnt_means: Mapping[str, object] | None = None,
) -> DataFrame:
    """Zero columns and mean columns in one projection."""
    mean = [c for c in _present(df, mean) if c not in zero]
    learnt = dict(learnt_means or {})
    unknown = [c for c in mean if learnt.get(c) is None]
    if unknown:
        row = df.agg(*[F.avg(quoted(c)) for c in unknown]).head()
        learnt.update({c: row[i] for i, c in enumerate(unknown)})
    values = {c: 0 for c in _present(df, zero)} | {c: learnt[c] for c in mean}
    return fill_values(df, values)
