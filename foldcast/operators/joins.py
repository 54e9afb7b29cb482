"""Equi-joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.operators.columns import quoted


def join_on(
    left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal keys, where null equals null as it does in a grouping. Each key
    column appears once, then the other columns of both sides."""
    if not names:
        raise ValueError("name the key columns")
    renamed = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & quoted(n).eqNullSafe(quoted(f"_right_{n}"))
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    keep_right = how in ("full_outer", "right")
    keys = [
        F.coalesce(quoted(n), quoted(f"_right_{n}")).alias(n) if keep_right else quoted(n)
        for n in names
    ]
    rest = [c for c in [*left.columns, *right.columns] if c not in names]
    return joined.select(*keys, *[quoted(c) for c in rest])
