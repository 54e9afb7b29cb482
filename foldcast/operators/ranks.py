"""Exact order statistics without a global sort.

A value at a given rank is found by narrowing: approximate percentiles bracket
the rank, one aggregate counts what lies below and inside, and this repeats on
the bracket until it holds few distinct values, whose counts give the answer.
Only numbers per column reach the driver, and no task holds more than the
distinct values of one small bracket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from foldcast.operators.columns import quoted

_ACCURACY = 10_000
_MARGIN = 4.0 / _ACCURACY
SMALL = 200_000


def rank_key(df: DataFrame, name: str) -> Column:
    """The column as a number in the same order."""
    kind = df.schema[name].dataType
    col = quoted(name)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return col.cast("double")
    if isinstance(kind, T.IntegralType):
        return col.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        # From the clock fields: a session zone would repeat an hour once a year.
        minutes = F.unix_date(col.cast("date")).cast("bigint") * 1440 + F.hour(col) * 60 + F.minute(col)
        micros = (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint")
        return minutes * 60_000_000 + micros
    raise ValueError(f"column {name} of type {kind.simpleString()} has no numeric order")


@dataclass
class _Bracket:
    low: float | int | None
    high: float | int | None
    below: int
    inside: int
    distinct: int

    def mask(self, key: Column) -> Column:
        kept = key
        if self.low is not None:
            kept = F.when((key >= self.low) & (key <= self.high), key)
        return kept


def values_at_ranks(
    df: DataFrame,
    keys: dict[str, Column],
    ranks: Callable[[int], Sequence[int]],
    small: int = SMALL,
    counts: Mapping[str, int] | None = None,
) -> dict[str, dict]:
    """Per named key: ``n`` non-null values, and ``values`` as (value, below, equal)
    for each wanted 0-based ascending rank. ``ranks`` maps n to the wanted ranks,
    which should lie close together. ``counts`` gives n per key where it is known."""
    names = list(keys)
    if not names:
        return {}
    if counts is None:
        # Spark numbers the columns, so any name may be used.
        row = df.agg(*[F.count(keys[name]) for name in names]).head()
        counts = {name: row[i] for i, name in enumerate(names)}
    wanted = {
        name: sorted({r for r in ranks(counts[name]) if 0 <= r < counts[name]}) for name in names
    }
    # Until a bracket is counted, its rows bound its distinct values.
    brackets = {name: _Bracket(None, None, 0, counts[name], counts[name]) for name in names}
    live = [name for name in names if wanted[name]]
    margin = {name: _MARGIN for name in live}
    while True:
        wide = [
            name for name in live if brackets[name].distinct > small and margin[name] < 0.5
        ]
        if not wide:
            break
        _narrow(df, keys, wanted, brackets, wide, margin)
    found = {name: {"n": counts[name], "values": {}} for name in names}
    for group in _by_type(df, keys, live):
        _finish(df, keys, wanted, brackets, group, found)
    return found


def _by_type(df: DataFrame, keys: dict[str, Column], names: Sequence[str]) -> list[list[str]]:
    kinds: dict[str, list[str]] = {}
    typed = df.select(*[keys[n].alias(n) for n in names]).schema if names else []
    for field in typed:
        kinds.setdefault(field.dataType.simpleString(), []).append(field.name)
    return list(kinds.values())


def _narrow(df, keys, wanted, brackets, names, margin) -> None:
    masked = {name: brackets[name].mask(keys[name]) for name in names}
    fractions = {}
    for name in names:
        b = brackets[name]
        span = max(b.inside - 1, 1)
        low = (wanted[name][0] - b.below) / span - margin[name]
        high = (wanted[name][-1] - b.below) / span + margin[name]
        fractions[name] = [max(low, 0.0), min(high, 1.0)]
    bounds = df.agg(
        *[F.percentile_approx(masked[n], fractions[n], _ACCURACY) for n in names]
    ).head()
    trial = {n: (bounds[i][0], bounds[i][1]) for i, n in enumerate(names)}
    aggs = []
    for n in names:
        low, high = trial[n]
        inside = F.when((keys[n] >= low) & (keys[n] <= high), keys[n])
        aggs += [
            F.count_if(keys[n] < low), F.count(inside), F.approx_count_distinct(inside),
        ]
    row = df.agg(*aggs).head()
    for i, n in enumerate(names):
        below, inside, distinct = row[3 * i], row[3 * i + 1], row[3 * i + 2]
        old = brackets[n]
        holds = below <= wanted[n][0] and wanted[n][-1] < below + inside
        low, high = trial[n]
        if not holds or inside >= old.inside:
            margin[n] *= 8  # the bracket missed or did not shrink: ask for a wider one
        else:
            brackets[n] = _Bracket(low, high, below, inside, 1 if low == high else distinct)


def _finish(df, keys, wanted, brackets, names, found) -> None:
    inside = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("name"), brackets[n].mask(keys[n]).alias("value"))
                    for n in names
                ]
            )
        ).alias("e")
    ).select("e.*")
    counted = inside.where("value is not null").groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("equal")
    )
    order = Window.partitionBy("name").orderBy("value")
    base = F.element_at(
        F.create_map(*[F.lit(x) for n in names for x in (n, brackets[n].below)]), F.col("name")
    )
    ranked = counted.withColumn("upto", base + F.sum("equal").over(order))
    hits = None
    for n in names:
        for r in wanted[n]:
            hit = (
                (F.col("name") == n)
                & (F.col("upto") > r)
                & (F.col("upto") - F.col("equal") <= r)
            )
            hits = hit if hits is None else hits | hit
    for row in ranked.where(hits).collect():  # at most one row per wanted rank
        start = row.upto - row.equal
        for r in wanted[row["name"]]:
            if start <= r < row.upto:
                found[row["name"]]["values"][r] = (row.value, start, row.equal)


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    small: int = SMALL,
    counts: Mapping[str, int] | None = None,
) -> dict[str, float]:
    """Median of the non-null values per column, the middle two averaged; a column
    without values is left out."""
    found = values_at_ranks(
        df,
        {c: rank_key(df, c) for c in columns},
        lambda n: [(n - 1) // 2, n // 2] if n else [],
        small,
        counts,
    )
    out = {}
    for name, hit in found.items():
        if hit["n"]:
            lower = hit["values"][(hit["n"] - 1) // 2][0]
            upper = hit["values"][hit["n"] // 2][0]
            out[name] = (lower + upper) / 2.0
    return out


def _row_at(df: DataFrame, keys: Sequence[Column], rank: int) -> list:
    """The keys of the row at a rank among few rows; it must differ from the one before."""
    named = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    before = min(rank, 1)
    rows = named.orderBy(*named.columns).offset(rank - before).limit(1 + before).collect()
    if before and rows[0] == rows[1]:
        raise ValueError("the order columns do not identify a row")
    return list(rows[-1])


def at_or_after_rank(
    df: DataFrame, order: Sequence[str | Column], rank: int, n: int, small: int = SMALL
) -> Column:
    """A predicate true for exactly the rows whose 0-based rank in ``order`` is at
    least ``rank``. Needs the row count and non-null order columns that are unique
    together.

    The boundary row is found column by column, so the split itself is a plain
    filter: no row is moved.
    """
    keys = [rank_key(df, c) if isinstance(c, str) else c for c in order]
    if not 0 <= rank < n:
        raise ValueError(f"rank {rank} is out of range")
    bounds: list = []
    inside = df
    left = rank
    for i, key in enumerate(keys):
        if n <= small:
            bounds += _row_at(inside, keys[i:], left)
            left = 0
            break
        hit = values_at_ranks(inside, {"k": key}, lambda _n, r=left: [r], small, {"k": n})["k"]
        value, below, n = hit["values"][left]
        bounds.append(value)
        left -= below
        inside = inside.where(key == value)
    if left != 0:
        raise ValueError("the order columns do not identify a row")
    predicate = None
    for key, value in reversed(list(zip(keys, bounds))):
        if predicate is None:
            predicate = key >= value
        else:
            predicate = (key > value) | ((key == value) & predicate)
    return predicate
