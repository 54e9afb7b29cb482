"""Column level steps: drop, order, rename, coerce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.functions.text import NUMBER

MASK_SUFFIX = "_mask"  # fixed value


def quoted(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in the data: {missing}")


def verify_columns(df: DataFrame, expected: Sequence[str]) -> dict[str, list[str]]:
    """Names on one side only, compared without surrounding blanks."""
    have = {c.strip() for c in df.columns}
    want = {e.strip() for e in expected}
    return {
        "not_in_table": [c for c in df.columns if c.strip() not in want],
        "not_in_data": [e.strip() for e in expected if e.strip() not in have],
    }


def remove_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def drop_mask_columns(df: DataFrame, suffix: str = MASK_SUFFIX) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def reorder_columns(
    df: DataFrame,
    targets: Sequence[str],
    batch: Sequence[str] = (),
    date: Sequence[str] = (),
    target_masks: Sequence[str] = (),
) -> DataFrame:
    """Batch, date, target masks, targets, then all other columns as they stand."""
    if not targets:
        raise ValueError("there must be at least one target column")
    head = [*batch, *date, *target_masks, *targets]
    require(df, head)
    tail = [c for c in df.columns if c not in head]
    return df.select(*[quoted(c) for c in [*head, *tail]])


def sort_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Global ascending sort by those of the names that the data has, nulls last."""
    present = [n for n in names if n in df.columns]
    return df.orderBy(*[quoted(n).asc_nulls_last() for n in present]) if present else df


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating columns, so that aggregates skip it."""
    def clean(field: T.StructField):
        col = quoted(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(col), col).alias(field.name)
        return col

    return df.select(*[clean(f) for f in df.schema.fields])


def known_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows on which all these columns are numbers.

    One condition per column, on the column itself: a joint test over many renamed
    columns makes the optimizer try every combination of old and new names.
    """
    for name in names:
        value = quoted(name).cast("double")
        df = df.where(value.isNotNull() & ~F.isnan(value))
    return df


def complete_masks(
    df: DataFrame, targets: Sequence[str], suffix: str = MASK_SUFFIX
) -> DataFrame:
    """A target without a mask column counts on every row: add a zero mask."""
    absent = {t + suffix: F.lit(0) for t in targets if t + suffix not in df.columns}
    return df.withColumns(absent) if absent else df


def _as_number(name: str):
    text = quoted(name).cast("string")
    # The pattern keeps out suffixes such as "1.5d", which the cast would take.
    value = F.when(text.rlike(NUMBER), F.trim(text)).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, force: bool = True
) -> DataFrame:
    """Coerce text columns to double.

    ``force=True``: what is not a number becomes null. ``force=False``: a column
    is converted only if all its values are numbers, else it stays as it is; one
    aggregate over all text columns decides.
    """
    chosen = [
        f.name for f in df.schema.fields
        if (columns is None or f.name in columns)
        and isinstance(f.dataType, T.StringType)
    ]
    if not force and chosen:
        text = {c: quoted(c).cast("string") for c in chosen}
        counts = df.agg(
            *[
                F.count_if(text[c].isNotNull() & ~text[c].rlike(NUMBER)).alias(str(i))
                for i, c in enumerate(chosen)
            ]
        ).head()
        chosen = [c for i, c in enumerate(chosen) if counts[i] == 0]
    return df.select(
        *[_as_number(c).alias(c) if c in chosen else quoted(c) for c in df.columns]
    )
