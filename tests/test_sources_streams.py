import re

import pytest
from pyspark.sql import functions as F

from foldcast import session
from foldcast.functions.metrics import SCORES
from foldcast.operators.ordered import lag_rows
from foldcast.operators.pseudonymise import code_index, pseudonymise_values
from foldcast.operators.scale import Stats, scale_std
from foldcast.operators.scores import score
from foldcast.sources.layout import RunLayout, lags_tag
from foldcast.sources.tables import prepared_csv, read_csv, read_table, write_csv
from foldcast.streaming.lags import run_row_lags
from foldcast.streaming.scoring import learnt_features, run_available, windowed_scores
from tests.conftest import rows_of


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", 2.5), (2, None, float("nan"))], "k int, s string, v double")
    path = str(tmp_path / "csv")
    assert write_csv(df, path) is df
    back = read_csv(spark, path, schema=df.schema)
    assert rows_of(back) == [(1, "a;b", 2.5), (2, None, None)]
    assert dict(read_csv(spark, path).dtypes)["k"] == "int"
    ready = prepared_csv(spark, path, ";", date_column="k", mask_null_values=True)
    assert {"v_mask", "s_mask"} <= set(ready.columns)
    with pytest.raises(ValueError):
        prepared_csv(spark, path, ";", date_column="absent")


def test_read_table(spark, tmp_path):
    path = str(tmp_path / "json")
    spark.range(3).write.json(path)
    assert read_table(spark, path, "json").count() == 3


def scan_of(plan):
    """The scan at the bottom of a plan that has one."""
    while plan.children().nonEmpty():
        plan = plan.children().head()
    return plan


def test_layout(spark, tmp_path):
    layout = RunLayout(str(tmp_path))
    df = spark.range(100).selectExpr("CAST(id % 2 AS INT) + 3 AS fold", "'train' AS split", "id")
    layout.write_folds(df, "ds", [1, 7], sort=["id"])
    layout.write_folds(df.where("fold = 3 AND id < 10"), "ds", [1, 7])  # rewrites one fold
    assert layout.read_folds(spark, "ds", [1, 7], fold=3).count() == 5
    assert layout.read_folds(spark, "ds", [1, 7], fold=4, split="train").count() == 50
    assert layout.read_folds(spark, "ds").count() == 0
    assert (lags_tag([1, 7]), lags_tag([])) == ("1x7", "none")
    plan = layout.read_folds(spark, "ds", [1, 7], fold=3)._jdf.queryExecution().executedPlan()
    filters = scan_of(plan).partitionFilters().mkString(";")  # not the plan's text, which is cut
    assert re.search(r"fold#\d+ = 3", filters)
    scores = spark.createDataFrame([("ds", 3, "RMSE", 1.0)], "dataset string, fold int, metric string, value double")
    layout.write_scores(scores)
    layout.write_scores(scores)
    assert spark.read.parquet(layout.scores).count() == 1  # replaced
    layout.write_scores(scores.withColumn("run", F.lit("b")))
    assert spark.read.parquet(layout.scores).count() == 2
    stats = spark.createDataFrame([(3, "v", 1.0)], "fold int, column string, mean double")
    layout.write_statistics(stats, "ds")
    layout.write_statistics(stats, "ds")
    layout.write_statistics(stats, "ds", [7])
    layout.write_statistics(stats, "ds", [7], valid_years=2)
    assert spark.read.parquet(layout.statistics).count() == 3
    assert layout.model("ds", 3, "r").endswith("/models/dataset=ds/fold=3/run=r")


class _Session:
    """Only what ``shared_folder`` looks at."""

    def __init__(self, master, folder):
        self.sparkContext = self
        self.master = master
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_shared_folder():
    assert session.shared_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_folder(_Session("local[4]", "/data/x")) == "/data/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(_Session("spark://host:7077", None))
    local = session.shared_folder(_Session("local[4]", None))
    assert local == session.shared_folder(_Session("local[4]", None)) and "foldcast-" in local


def test_materialise_and_discard(spark, monkeypatch):
    monkeypatch.setattr(session, "_created", [])
    stored = session.materialise(spark.range(5), "five")
    assert stored.count() == 5
    assert session.shared_folder(spark).removeprefix("file:") in stored.inputFiles()[0]
    assert session.discard(spark) == 1 and session.discard(spark) == 0


def test_checked_broadcast(spark):
    small = session.checked_broadcast(spark.range(10), "t", max_rows=10)
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower()
    large = session.checked_broadcast(spark.range(11), "t", max_rows=10)
    assert "broadcast" not in large._jdf.queryExecution().analyzed().toString().lower()


def test_pseudonymise_values(spark):
    long = "x" * 50_000 + "1234"
    texts = ["visit 6003 and 6005", "60036003\n6003", "no code 12", None, "", long, "123456789"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = {r.id: r.t for r in pseudonymise_values(df, "t", "s").collect()}
    index = {r.code: r.idx for r in code_index(df, "t", "s").collect()}
    assert sorted(index.values()) == list(range(len(index)))
    place = {code: f"Place{i}" for code, i in index.items()}
    assert out[0] == f"visit {place['6003']} and {place['6005']}"
    assert out[1] == f"{place['6003']}{place['6003']}\n{place['6003']}"
    assert (out[2], out[3], out[4]) == ("no code 12", None, "")
    assert out[5] == "x" * 50_000 + place["1234"]
    assert out[6] == f"{place['1234']}{place['5678']}9"


@pytest.fixture
def event_folder(spark, tmp_path):
    """Four files in time order, plus a late row in the last."""
    path = tmp_path / "events"
    schema = "event_id long, ts timestamp_ntz, k string, y double, p double"
    for i in range(4):
        part = spark.range(i * 50, i * 50 + 50).selectExpr(
            "id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts",
            "IF(id % 3 = 0, 'hot', concat('k', id % 7)) AS k", "CAST(id % 11 AS DOUBLE) AS y",
            "CAST(id % 5 + 1 AS DOUBLE) AS p")
        part.coalesce(1).write.mode("append").parquet(str(path))
    return str(path), spark.read.parquet(str(path)).schema, schema


def stream_of(spark, event_folder):
    path, schema, _ = event_folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_scores_equal_batch(spark, event_folder):
    stream = stream_of(spark, event_folder)
    out = run_available(
        windowed_scores(stream, "ts", F.col("y"), F.col("p"), ["k"]), "scores")
    batch = spark.read.parquet(event_folder[0]).withColumn("day", F.date_trunc("day", "ts"))
    last = batch.agg(F.max("day")).head()[0]
    expected = score(batch.where(F.col("day") < last), F.col("y"), F.col("p"), ["day", "k"])
    got = {(str(r.window_start), r.k): tuple(r)[2:] for r in out.collect()}
    want = {(str(r.day), r.k): tuple(r)[2:] for r in expected.collect()}
    assert got.keys() == want.keys() and len(got) > 10
    for key in got:
        assert got[key] == pytest.approx(want[key], abs=1e-9)
    assert out.columns == ["window_start", "k", "n", *SCORES]


def test_stream_features_equal_batch(spark, event_folder):
    learnt = {"y": Stats(5.0, 2.0, 0.0, 10.0)}
    stream = stream_of(spark, event_folder).select("event_id", "y", F.col("p").cast("int").alias("p"))
    out = run_available(learnt_features(stream, std=learnt, ranges={"p": (1, 4)}), "features")
    batch = scale_std(spark.read.parquet(event_folder[0]).select("event_id", "y"), ["y"], learnt)
    assert rows_of(out, "event_id", "y") == rows_of(batch)
    assert out.columns == ["event_id", "y", "p_1", "p_2", "p_3"]


def test_stream_lags_equal_batch(spark, event_folder):
    """Four micro-batches; keys carry their last rows from one to the next."""
    stream = stream_of(spark, event_folder).select("event_id", "ts", "k", "y")
    out = run_row_lags(stream, ["y"], [1, 3], ["ts", "event_id"], ["k"])
    batch = lag_rows(
        spark.read.parquet(event_folder[0]).select("event_id", "ts", "k", "y"),
        ["y"], [1, 3], ["ts", "event_id"], ["k"], chunk_rows=None)
    assert rows_of(out.select(*batch.columns)) == rows_of(batch)
    with pytest.raises(ValueError):
        run_row_lags(stream, ["y"], [-1], ["ts"], ["k"])


def test_stream_lags_follow_arrival_for_late_rows(spark, tmp_path):
    path = str(tmp_path / "late")
    for ids in ([10, 20], [5], [30]):
        spark.createDataFrame([(i, "k", float(i)) for i in ids], "t long, k string, v double"
                              ).coalesce(1).write.mode("append").parquet(path)
    stream = (spark.readStream.schema("t long, k string, v double")
              .option("maxFilesPerTrigger", 1).parquet(path))
    out = run_row_lags(stream, ["v"], [1, 2], ["t"], ["k"])
    assert rows_of(out, "t", "v_l1", "v_l2") == [
        (5, 20.0, 10.0), (10, None, None), (20, 10.0, None), (30, 5.0, 20.0)]


def test_stream_lags_touch_only_the_keys_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "keys")
    parts = ([(i, f"k{i % 40}", i) for i in range(200)], [(300, "k1", 2**60 + 1), (301, "k2", None)], [(302, "k1", 5)])
    for part in parts:
        spark.createDataFrame(part, "t long, k string, v long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("t long, k string, v long").option("maxFilesPerTrigger", 1).parquet(path)
    seen = []
    out = run_row_lags(stream, ["v"], [1, 2], ["t"], ["k"], timeout=60, progress=seen)
    states = [p["stateOperators"][0] for p in seen if p["numInputRows"]]
    assert [s["numRowsUpdated"] for s in states] == [40, 2, 1]
    assert [s["numRowsTotal"] for s in states] == [40, 40, 40]
    rows = {r.t: (r.v_l1, r.v_l2) for r in out.collect()}
    assert rows[300] == (161, 121) and rows[301] == (162, 122) and rows[302] == (2**60 + 1, 161)


def test_stream_lags_resume_after_a_stop(spark, tmp_path):
    """Null keys and values, columns of other names, two lagged columns."""
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "t long, k string, v double, `a.b` string, _key0 int"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        return run_row_lags(stream, ["v", "a.b"], [1, 2], ["t"], ["k"], folder=folder, timeout=60)

    add([(1, None, 1.0, "x", 0), (2, "k", None, None, 0), (3, None, 3.0, None, 0)])
    assert run().count() == 3
    assert run().count() == 3  # nothing new
    add([(4, None, 4.0, "y", 0), (5, "k", 5.0, "z", 0)])
    rows = {r["t"]: tuple(r)[5:] for r in run().collect()}
    assert rows == {
        1: (None, None, None, None), 3: (1.0, None, "x", None), 4: (3.0, 1.0, None, "x"),
        2: (None, None, None, None), 5: (None, None, None, None),
    }
    with pytest.raises(ValueError):
        run_row_lags(spark.readStream.schema("t long, k string, v double, v_l1 int").parquet(path), ["v"], [1], ["t"], ["k"])


def broken_at(stream, limit):
    """Stops at the first row from ``limit`` on."""
    return stream.where(F.when(F.col("event_id") >= limit, F.raise_error(F.lit("cut off"))).otherwise(True))


def test_stream_scores_resume_after_a_failure(spark, event_folder, tmp_path):
    """A query dies in its second batch, another one takes its folder over; a late row after that is dropped."""
    path, schema, _ = event_folder
    folder = str(tmp_path / "scores")

    def scores(stream):
        return windowed_scores(stream, "ts", F.col("y"), F.col("p"), ["k"])

    seen = []
    with pytest.raises(Exception, match="cut off"):
        run_available(scores(broken_at(stream_of(spark, event_folder), 50)), "scores", 60, folder, seen)
    assert [p["batchId"] for p in seen if p["numInputRows"]] == [0]
    resumed = []
    out = run_available(scores(stream_of(spark, event_folder)), "scores", 60, folder, resumed)
    assert sum(p["numInputRows"] for p in resumed) == 150  # not the first file again
    want = run_available(scores(stream_of(spark, event_folder)), "scores")
    assert rows_of(out) == rows_of(want) and out.count() > 10
    before = out.count()
    late = spark.createDataFrame([(999, 3.0, 1.0)], "event_id long, y double, p double").selectExpr(
        "event_id", "TIMESTAMP_NTZ'2024-01-01 05:00:00' AS ts", "'late' AS k", "y", "p")
    late.coalesce(1).write.mode("append").parquet(path)
    again = run_available(scores(stream_of(spark, event_folder)), "scores", 60, folder)
    assert again.count() == before and again.where("k = 'late'").count() == 0


def test_stream_features_resume_after_a_failure(spark, event_folder, tmp_path):
    folder = str(tmp_path / "features")
    learnt = {"y": Stats(5.0, 2.0, 0.0, 10.0)}

    def features(stream):
        return learnt_features(stream.select("event_id", "y"), std=learnt)

    with pytest.raises(Exception, match="cut off"):
        run_available(features(broken_at(stream_of(spark, event_folder), 120)), "features", 60, folder)
    kept = spark.read.parquet(f"{folder}/table").count()
    assert kept == 100
    out = run_available(features(stream_of(spark, event_folder)), "features", 60, folder)
    batch = scale_std(spark.read.parquet(event_folder[0]).select("event_id", "y"), ["y"], learnt)
    assert rows_of(out) == rows_of(batch)
