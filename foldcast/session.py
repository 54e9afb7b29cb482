"""Session helpers: a local session for tests, and tables kept for a second read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int | str = "*", app: str = "foldcast", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a fresh temporary folder. On a
    cluster a machine-local folder would lose data with its machine, so that is
    an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="foldcast-"))
    return _local_folder[0]


_created: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/foldcast/{label}-{uuid.uuid4().hex}"
    _created.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Delete the tables this process has written to the shared folder; returns their
    number. Call it when no frame that reads them is needed any more."""
    deleted = 0
    while _created:
        path = spark._jvm.org.apache.hadoop.fs.Path(_created.pop())
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        deleted += bool(files.delete(path, True))
    return deleted


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and freezes values that
    depend on physical partitions. Later reads prune columns and push filters.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame) -> DataFrame:
    """A table with a known small number of rows, such as one per year or fold, worked
    out now, so that a plan that uses it several times does not repeat its scan."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def checked_broadcast(
    df: DataFrame, label: str, max_rows: int = 200_000, max_bytes: int = 64 << 20
) -> DataFrame:
    """The right side of a join: worked out once, measured, and broadcast only if it is
    small. A larger one is joined by a shuffle, in which AQE splits hot keys."""
    stored = materialise(df, label)
    return F.broadcast(stored) if _is_small(stored, max_rows, max_bytes) else stored


def _is_small(stored: DataFrame, max_rows: int, max_bytes: int) -> bool:
    if stored.count() > max_rows:
        return False
    of_any_length = [
        f.name for f in stored.schema.fields
        if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
    ]
    if not of_any_length:
        return True
    letters = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in of_any_length])))
    return (stored.agg(F.sum(letters)).head()[0] or 0) <= max_bytes
