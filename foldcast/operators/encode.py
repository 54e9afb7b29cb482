"""One-hot columns, from observed values or from a declared range; sparse where there are many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.operators.columns import quoted, require
from foldcast.operators.ordered import dense_index
from foldcast.operators.profile import MOST_VALUES, distinct_values
from foldcast.session import checked_broadcast, materialise


def _indicators(df: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    kept = [quoted(c) for c in df.columns if c not in values]
    names = [c for c in df.columns if c not in values] + [f"{c}_{v}" for c, vs in values.items() for v in vs]
    twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
    if twice:
        raise ValueError(f"columns of the same name: {', '.join(twice)}")
    new = [
        F.coalesce((quoted(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, observed in values.items()
        for v in observed
    ]
    return df.select(*kept, *new)


def indicator_names(values: Mapping[str, Sequence]) -> dict[str, list[str]]:
    """Source column to its new columns."""
    return {c: [f"{c}_{v}" for v in observed] for c, observed in values.items()}


def onehot(
    df: DataFrame,
    columns: Sequence[str],
    values: Mapping[str, Sequence] | None = None,
    cap: int = MOST_VALUES,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """A 0/1 column per observed value, in value order; the source is dropped.

    A null gives 0 everywhere. Pass ``values`` to reuse those of an earlier run. A column
    with more than ``cap`` values is an error: use ``sparse_onehot``.
    Returns the frame and the mapping from old to new names.
    """
    require(df, columns)
    if values is None:
        values = {c: distinct_values(df, c, cap) for c in columns}
    return _indicators(df, values), indicator_names(values)


def onehot_range(
    df: DataFrame, limits: Mapping[str, tuple[int, int]]
) -> tuple[DataFrame, dict[str, list[str]]]:
    """As ``onehot`` for the values low .. high-1. The schema is fixed without a
    look at the data, so this also works on a stream."""
    require(df, list(limits))
    values = {c: list(range(low, high)) for c, (low, high) in limits.items()}
    return _indicators(df, values), indicator_names(values)


def value_dictionaries(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, DataFrame], int]:
    """Per column a table (value, code) of its distinct values without null, and the number of
    codes of all columns together. The codes of a column follow those of the one before, in
    value order, so a code is the place of the indicator among all indicators.

    The values are sorted and numbered by range, so a column may have as many as it has rows;
    only their count comes to the driver.
    """
    require(df, columns)
    tables, width = {}, 0
    for c in columns:
        found = df.select(quoted(c).alias("value")).where("value is not null").distinct()
        coded = dense_index(found, ["value"], name="code").withColumn("code", F.col("code") + F.lit(width))
        tables[c] = materialise(coded, "dictionary")
        width += tables[c].count()
    return tables, width


def sparse_onehot(df: DataFrame, dictionaries: Mapping[str, DataFrame], name: str = "hot") -> DataFrame:
    """The rows with the columns of ``dictionaries`` replaced by ``name``: the places of their
    ones, ascending. Nulls and values that are not in a dictionary have no place.

    Each dictionary is broadcast if it is small, and joined by a shuffle otherwise.
    """
    require(df, list(dictionaries))
    kept = [c for c in df.columns if c not in dictionaries]
    if name in kept:
        raise ValueError(f"the data have a column {name}")
    out, codes = df, []
    for i, (c, coded) in enumerate(dictionaries.items()):
        code, value = f"_code_{i}", f"_value_{i}"
        side = coded.select(F.col("value").alias(value), F.col("code").alias(code))
        out = out.join(checked_broadcast(side, "dictionary"), quoted(c) == F.col(value), "left").drop(value)
        codes.append(F.col(code))
    places = F.array_compact(F.array(*codes)) if codes else F.array().cast("array<bigint>")
    return out.select(*[quoted(c) for c in kept], places.alias(name))


def sparse_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample std, min and max of the indicator of every value, a row per column and
    value (as text), without the indicators: they follow from how often the value occurs."""
    require(df, columns)
    total = df.count()
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns
    ]))
    ones, n = F.col("n").cast("double"), F.lit(float(total))
    return (
        df.select(pairs.alias("_e")).select("_e.*").where("value is not null")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column", "value", (ones / n).alias("mean"),
            F.sqrt(ones * (n - ones) / F.nullif(n * (n - 1), F.lit(0.0))).alias("std"),
            F.when(ones == n, 1.0).otherwise(0.0).alias("min"), F.lit(1.0).alias("max"),
        )
    )
