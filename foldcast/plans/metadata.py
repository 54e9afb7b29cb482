"""The column table: one entry per data column with its role and policies.

It is small and lives on the driver, where it decides which expressions a job is
built from. It is immutable: a step that learns something returns a new table.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.operators.scale import Stats

# The vocabulary of the table and the headers of its file.
BATCH, REMOVE, TARGET = "batch", "remove", "target"
ONE_TO_MANY, DATE, TARGET_MASK = "onetomany", "date", "target_mask"
STD, MINMAX = "std", "minmax"
ZERO, MEAN = "zero", "mean"
HEADERS = {
    "name": "Column Header",
    "known_days": "KnownDaysInAdvanced",
    "operation": "Operation",
    "normalisation": "Normalisation",
    "null_value": "NullValue",
    "sort": "Sort",
    "mean": "mean",
    "std": "std",
    "min": "min",
    "max": "max",
    "cardinality": "cardinality",
    "nan_values": "nan_values",
}
SCHEMA = T.StructType(
    [T.StructField("name", T.StringType(), False), T.StructField("known_days", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("operation", "normalisation", "null_value", "sort")]
    + [T.StructField(n, T.DoubleType()) for n in ("mean", "std", "min", "max")]
    + [T.StructField(n, T.LongType()) for n in ("cardinality", "nan_values")]
)

COMPARISONS = {">=": operator.ge, "==": operator.eq, "<=": operator.le}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    known_days: int | None = None
    operation: str | None = None
    normalisation: str | None = None
    null_value: str | None = None
    sort: str | None = None
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    cardinality: int | None = None
    nan_values: int | None = None


def _sort_number(spec: ColumnSpec) -> int | None:
    match = re.fullmatch(r"asc([0-9]+)", spec.sort or "", re.IGNORECASE)
    return int(match[1]) if match else None


@dataclass(frozen=True)
class ColumnTable:
    specs: tuple[ColumnSpec, ...]

    @staticmethod
    def of(specs: Iterable[ColumnSpec]) -> "ColumnTable":
        return ColumnTable(tuple(specs))

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.specs]

    def _names(self, condition) -> list[str]:
        return [s.name for s in self.specs if condition(s)]

    def with_operation(self, operation: str) -> list[str]:
        return self._names(lambda s: s.operation == operation)

    def targets(self) -> list[str]:
        return self.with_operation(TARGET)

    def features(self) -> list[str]:
        """Plain columns and one-hot columns."""
        return self._names(lambda s: not s.operation or s.operation == ONE_TO_MANY)

    def date_column(self) -> str:
        dates = self.with_operation(DATE)
        if len(dates) != 1:
            raise ValueError(f"need exactly one date column, found {len(dates)}")
        return dates[0]

    def normalised(self, kind: str) -> list[str]:
        return self._names(lambda s: s.normalisation == kind)

    def null_policy(self, kind: str) -> list[str]:
        return self._names(lambda s: s.null_value == kind)

    def sort_columns(self) -> list[str]:
        keyed = [(n, s.name) for s in self.specs if (n := _sort_number(s)) is not None]
        return [name for _, name in sorted(keyed, key=lambda k: k[0])]

    def known_ahead(self, days: int, comparison: str = ">=") -> list[str]:
        """Columns whose value is known that many days before: with ``>=`` those
        that a forecast over that horizon may use."""
        compare = COMPARISONS[comparison]
        return self._names(lambda s: s.known_days is not None and compare(s.known_days, days))

    def with_statistics(self) -> list[str]:
        return self._names(
            lambda s: any(v is not None for v in (s.mean, s.std, s.min, s.max))
        )

    def declared_ranges(self) -> dict[str, tuple[int, int]]:
        """Columns declared as ``onetomany:low:high``."""
        out = {}
        for s in self.specs:
            parts = (s.operation or "").split(":")
            if parts[0] == ONE_TO_MANY and len(parts) == 3:
                out[s.name] = (int(parts[1]), int(parts[2]))
        return out

    def learnt(self) -> dict[str, Stats]:
        return {s.name: Stats(s.mean, s.std, s.min, s.max) for s in self.specs}

    def replace_columns(self, new_names: Mapping[str, Sequence[str]]) -> "ColumnTable":
        """Each named entry gives way to one copy per new name, at the end."""
        kept = [s for s in self.specs if s.name not in new_names]
        copies = [
            replace(s, name=new, operation=ONE_TO_MANY)
            for s in self.specs
            for new in new_names.get(s.name, ())
        ]
        return ColumnTable.of([*kept, *copies])

    def with_lags(self, lags: Sequence[int], template: str = "{col}_l{n}") -> "ColumnTable":
        """Feature entries for the lags of every target, copied from the target."""
        copies = [
            replace(s, name=template.format(col=s.name, n=lag), operation=None)
            for s in self.specs
            if s.operation == TARGET
            for lag in lags
        ]
        return ColumnTable.of([*self.specs, *copies])

    def updated(self, values: Mapping[str, Mapping[str, object]]) -> "ColumnTable":
        """New statistics by column name; what is not given stays."""
        return ColumnTable.of(
            replace(s, **{k: v for k, v in values.get(s.name, {}).items() if v is not None})
            for s in self.specs
        )

    def updated_from(self, stats: DataFrame) -> "ColumnTable":
        """Take over a profile with a row per column (bounded by the columns)."""
        allowed = {f.name for f in fields(ColumnSpec)}
        return self.updated(
            {
                row["column"]: {k: v for k, v in row.asDict().items() if k in allowed}
                for row in stats.collect()
            }
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(s).values()) for s in self.specs], SCHEMA)

    def write(
        self, spark: SparkSession, path: str, delimiter: str = ";", mode: str = "error"
    ) -> None:
        named = self.to_df(spark).withColumnsRenamed(HEADERS).coalesce(1)
        named.write.mode(mode).option("sep", delimiter).option("header", True).csv(path)

    @staticmethod
    def from_df(df: DataFrame) -> "ColumnTable":
        """From a small table with the headers above, in the file's or our names."""
        own = {header: name for name, header in HEADERS.items()}
        df = df.withColumnsRenamed(own)
        cols = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMA.fields
        ]
        def filled(value):
            return None if value == "" else value

        return ColumnTable.of(
            ColumnSpec(*[filled(v) for v in row]) for row in df.select(*cols).collect()
        )

    @staticmethod
    def read(spark: SparkSession, path: str, delimiter: str = ";") -> "ColumnTable":
        text = spark.read.option("sep", delimiter).option("header", True).csv(path)
        return ColumnTable.from_df(text)
