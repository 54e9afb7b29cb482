"""Positions, row lags and blocks on rows of any number per key.

All operators here take an order that identifies a row. Rows are range
partitioned by key and order, so a key that holds a third of all rows spreads
over a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldcast.operators.columns import quoted, require
from foldcast.operators.joins import join_on
from foldcast.session import checked_broadcast, materialise

_POSITION_BITS = 33  # of monotonically_increasing_id


def dense_index(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Add the 0-based position of each row in ``order``, within its key.

    One range shuffle. The sorted rows are written to the shared folder, since
    the position within a partition must not change between the two reads that
    follow: the row counts per partition, and the rows.
    """
    require(df, [*keys, *order])
    cols = [*keys, *order]
    placed = (
        df.repartitionByRange(*[quoted(c) for c in cols])
        .sortWithinPartitions(*[quoted(c) for c in cols])
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = materialise(placed, "ordered").withColumn(
        "_part", F.shiftright("_place", _POSITION_BITS)
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    # One row per partition, so the single-task window and the broadcast are small.
    starts = (
        stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_rows").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_start"),
        )
    )
    indexed = stored.join(F.broadcast(starts), "_part").withColumn(
        name, (F.col("_start") + within).cast("bigint")
    )
    if keys:
        first = indexed.groupBy(*map(quoted, keys)).agg(F.min(name).alias("_first"))
        indexed = join_on(indexed, checked_broadcast(first, "first"), keys).withColumn(
            name, F.col(name) - F.col("_first")
        )
    return indexed.select(*[quoted(c) for c in df.columns], F.col(name))


def longest_key(df: DataFrame, keys: Sequence[str] = ()) -> int:
    """Rows of the key that has most (of the table without keys); one small aggregate
    that reads the key columns only."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).head()[0] or 0


def lag_name(column: str, shift: int, template: str) -> str:
    return template.format(col=column, n=shift)


def lag_columns(
    columns: Sequence[str],
    shifts: Sequence[int],
    window,
    template: str = "{col}_l{n}",
    transformation: Callable[[Column], Column] | None = None,
) -> dict[str, Column]:
    """One column per source column and shift; a negative shift looks ahead."""
    out = {}
    for column in columns:
        for shift in shifts:
            value = (
                F.lag(quoted(column), shift) if shift >= 0 else F.lead(quoted(column), -shift)
            ).over(window)
            out[lag_name(column, shift, template)] = (
                transformation(value) if transformation else value
            )
    return out


def lag_rows(
    df: DataFrame,
    columns: Sequence[str],
    shifts: Sequence[int],
    order: Sequence[str],
    keys: Sequence[str] = (),
    template: str = "{col}_l{n}",
    transformation: Callable[[Column], Column] | None = None,
    chunk_rows: int | None = 1_000_000,
) -> DataFrame:
    """Values of the row ``n`` places earlier in the key's order.

    ``chunk_rows=None`` states that each key is short, such as one row per
    calendar day, and uses one window per key. Otherwise a key is cut into
    chunks, each with the few rows before and after it that its lags reach, so
    that no task holds a whole key.
    """
    require(df, [*columns, *keys, *order])
    if not shifts:
        return df
    if chunk_rows is None:
        window = Window.partitionBy(*map(quoted, keys)).orderBy(*map(quoted, order))
        return df.withColumns(lag_columns(columns, shifts, window, template, transformation))
    return lag_indexed(
        dense_index(df, order, keys, "_idx"), columns, shifts, keys, template, transformation,
        chunk_rows,
    ).drop("_idx")


def lag_indexed(
    indexed: DataFrame,
    columns: Sequence[str],
    shifts: Sequence[int],
    keys: Sequence[str] = (),
    template: str = "{col}_l{n}",
    transformation: Callable[[Column], Column] | None = None,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Row lags of rows that already have their position ``_idx``, chunk by chunk."""
    before, after = max(0, *shifts), max(0, *[-s for s in shifts])
    size = max(chunk_rows, before, after, 1)
    offset = F.col("_idx") % size
    chunk = F.expr(f"_idx div {size}")
    copies = F.array_compact(
        F.array(
            chunk,
            F.when(offset >= size - before, chunk + 1),
            F.when((offset < after) & (chunk > 0), chunk - 1),
        )
    )
    window = Window.partitionBy(*map(quoted, keys), "_chunk").orderBy("_idx")
    return (
        indexed.withColumn("_chunk", F.explode(copies))
        .withColumns(lag_columns(columns, shifts, window, template, transformation))
        .where(F.col("_chunk") == chunk)
        .drop("_chunk")
    )


def sequence_blocks(
    df: DataFrame,
    values: Sequence[str],
    order: Sequence[str],
    steps: int,
    keys: Sequence[str] = (),
    drop_remainder: bool = False,
    batch_blocks: int | None = None,
) -> DataFrame:
    """Consecutive rows of a key in blocks of ``steps``: one row per block with the
    values as an array of structs in order. The last block may be shorter."""
    if steps < 1:
        raise ValueError("steps must be positive")
    indexed = dense_index(df, order, keys, "_idx").withColumn(
        "block", F.expr(f"_idx div {steps}")
    )
    record = F.struct("_idx", *[quoted(v) for v in values])
    blocks = (
        indexed.groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(record)).alias("_records"))
        .select(
            *keys,
            "block",
            F.size("_records").alias("n"),
            F.transform(
                "_records", lambda r: F.struct(*[r[v].alias(v) for v in values])
            ).alias("records"),
        )
    )
    if drop_remainder:
        blocks = blocks.where(F.col("n") == steps)
    if batch_blocks:
        blocks = blocks.withColumn("batch", F.expr(f"block div {batch_blocks}"))
    return blocks


def series_block(
    df: DataFrame,
    values: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str],
    most_rows: int = 100_000,
) -> DataFrame:
    """The whole series of each key as one block, for series with one row per day.

    A key with more than ``most_rows`` rows is an error: use ``series_blocks``.
    """
    if not keys:
        raise ValueError("name the key of the series: a whole table is never one block")
    if longest_key(df, keys) > most_rows:
        raise ValueError(f"a key has more than {most_rows} rows: cut it into series_blocks")
    record = F.struct(*[quoted(o) for o in order], *[quoted(v) for v in values])
    return df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(record)).alias("records"),
        F.count(F.lit(1)).cast("int").alias("n"),
    )


def series_blocks(
    df: DataFrame,
    values: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str],
    block_rows: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """The whole series of each key, of any length: (blocks, index).

    The blocks of a key in order of ``block`` are its series: rows (keys, block, first, n,
    records), where ``first`` is the position of the first record. The index has a row per key
    with the length of its series, the number of its blocks, and the first and last record. No
    task holds more than a block of a key; the blocks are stored, so both read them.
    """
    names = [*order, *[v for v in values if v not in order]]
    cut = sequence_blocks(df, names, order, block_rows, keys)
    blocks = materialise(cut.withColumn("first", F.col("block") * block_rows), "series").select(
        *map(quoted, keys), "block", "first", "n", "records"
    )
    ends = blocks.select(
        *map(quoted, keys), "block", "n", F.element_at("records", 1).alias("_low"),
        F.element_at("records", -1).alias("_high"),
    )
    index = ends.groupBy(*map(quoted, keys)).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_blocks"),
        F.min_by("_low", "block").alias("first_record"), F.max_by("_high", "block").alias("last_record"),
    )
    return blocks, index
