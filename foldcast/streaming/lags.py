"""Row lags on a stream: the last values of each key are state that Spark keeps between batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foldcast.operators.columns import quoted
from foldcast.streaming.scoring import run_available


#: Types that pandas cannot hold beside nulls, or not in their whole range: they pass as text, which
#: keeps every value.
_AS_TEXT = (T.IntegralType, T.TimestampType, T.TimestampNTZType)


class _LastValues(StatefulProcessor):
    """One state row per key: an array of the last values of each lagged column, oldest first.

    A batch reads and writes the rows of the keys it has; all others are left alone."""

    def __init__(self, columns: Sequence[str], shifts: Sequence[int], order: Sequence[str], names: Sequence[str],
                 schema: T.StructType, whole_numbers: Sequence[str]):
        self._columns, self._shifts, self._order = list(columns), list(shifts), list(order)
        self._whole_numbers = set(whole_numbers)
        self._names, self._depth = list(names), max(shifts)
        self._schema = T.StructType([T.StructField(f"v{i}", T.ArrayType(schema[c].dataType)) for i, c in enumerate(columns)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("last_values", self._schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new.sort_values(self._order, na_position="first", kind="stable", ignore_index=True, key=self._sort_key)
        held = self._state.get() if self._state.exists() else ([],) * len(self._columns)
        out, kept = {c: new[c] for c in new.columns}, []
        for column, before in zip(self._columns, held):
            values = [*before, *new[column].astype(object).where(new[column].notna(), None)]
            first = len(before)
            for n in self._shifts:
                name = self._names[self._columns.index(column) * len(self._shifts) + self._shifts.index(n)]
                lagged = [values[i - n] if i >= n else None for i in range(first, len(values))]
                out[name] = pd.Series(lagged, dtype=object)
            kept.append(values[-self._depth :])
        self._state.update(tuple(kept))
        yield pd.DataFrame(out)

    def _sort_key(self, values: pd.Series) -> pd.Series:
        """Whole numbers as such; times as text are in order."""
        if values.name not in self._whole_numbers:
            return values
        return values.map(lambda x: x if x is None else int(x)).astype(object)

    def close(self) -> None:
        pass


def row_lags(
    stream: DataFrame,
    columns: Sequence[str],
    shifts: Sequence[int],
    order: Sequence[str],
    keys: Sequence[str],
    template: str = "{col}_l{n}",
) -> DataFrame:
    """The stream with a column per lagged column and shift, over the order of arrival: batches in
    turn, each in ``order`` (nulls first; null keys are one key).

    State is one row per key that holds the last ``max(shifts)`` values. A batch touches the rows of
    its own keys only, whatever the number of keys seen before. A task holds the rows that one key has in
    one batch, so the source's limits per trigger bound its memory. The session needs the RocksDB state
    store, see ``run_row_lags``.
    """
    if not keys or not columns or not shifts:
        raise ValueError("keys, columns and shifts are needed")
    if any(s <= 0 for s in shifts):
        raise ValueError("a stream cannot look ahead: shifts must be positive")
    names = [template.format(col=c, n=n) for c in columns for n in shifts]
    taken = [n for n in names if n.lower() in {c.lower() for c in stream.columns}]
    if taken or len(set(names)) < len(names):
        raise ValueError(f"lag columns clash: {taken or names}")
    # inside, columns go by number: the operator takes no dots in names, and grouping keys leave the rows
    place = {f.name: f"c{i}" for i, f in enumerate(stream.schema)}
    passed = stream.select(*[
        (quoted(f.name).cast("string") if isinstance(f.dataType, _AS_TEXT) else quoted(f.name)).alias(place[f.name])
        for f in stream.schema
    ])
    schema = T.StructType(list(passed.schema.fields))
    back = [F.col(place[f.name]).cast(f.dataType).alias(f.name) for f in stream.schema]
    for i, name in enumerate(names):
        source = columns[i // len(shifts)]
        schema = schema.add(f"l{i}", passed.schema[place[source]].dataType)
        back.append(F.col(f"l{i}").cast(stream.schema[source].dataType).alias(name))
    named = passed.select("*", *[F.col(place[k]).alias(f"k{i}") for i, k in enumerate(keys)])
    processor = _LastValues(
        [place[c] for c in columns], shifts, [place[c] for c in order], [f"l{i}" for i in range(len(names))],
        passed.schema, [place[f.name] for f in stream.schema if isinstance(f.dataType, T.IntegralType)],
    )
    grouped = named.groupBy(*[f"k{i}" for i in range(len(keys))])
    out = grouped.transformWithStateInPandas(processor, schema, "Append", "None")
    return out.select(*back)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_row_lags(
    stream: DataFrame,
    columns: Sequence[str],
    shifts: Sequence[int],
    order: Sequence[str],
    keys: Sequence[str],
    label: str = "stream_lags",
    template: str = "{col}_l{n}",
    timeout: int | None = None,
    folder: str | None = None,
    progress: list | None = None,
) -> DataFrame:
    """Lag what is there now and read the table. A run with a ``folder`` that an earlier run has used goes
    on behind it, with that run's state; see ``run_available``."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # the only store with state of this form; asked for when a query starts
    try:
        lagged = row_lags(stream, columns, shifts, order, keys, template)
        return run_available(lagged, label, timeout, folder, progress)
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
