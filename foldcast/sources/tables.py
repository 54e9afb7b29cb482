"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foldcast.operators.columns import nan_to_null, to_numeric
from foldcast.operators.impute import mask_null_median


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ";",
    schema: T.StructType | None = None,
    encoding: str = "utf-8",
) -> DataFrame:
    """A CSV table with a header. Give the schema for large data: inference reads
    everything once more. Spark splits the files; NaN becomes null."""
    reader = (
        spark.read.option("sep", delimiter).option("header", True).option("encoding", encoding)
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Any table Spark reads by path: parquet, orc, json and others."""
    return nan_to_null(spark.read.format(kind).load(path))


def prepared_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    schema: T.StructType | None = None,
    force_numeric: bool = False,
    date_column: str | None = None,
    mask_null_values: bool = False,
) -> DataFrame:
    """CSV table, optionally coerced to numbers and with nulls masked and filled."""
    df = read_csv(spark, path, delimiter, schema)
    if date_column is not None and date_column not in df.columns:
        raise ValueError(f"date column {date_column} is not in the data")
    df = to_numeric(df, force=force_numeric)
    return mask_null_median(df) if mask_null_values else df


def write_csv(
    df: DataFrame, path: str, delimiter: str = ";", encoding: str = "utf-8", mode: str = "error"
) -> DataFrame:
    """Write with a header and pass the frame on."""
    (
        df.write.mode(mode).option("sep", delimiter).option("header", True)
        .option("encoding", encoding).csv(path)
    )
    return df
