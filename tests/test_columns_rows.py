import pytest
from pyspark.sql import functions as F

from foldcast.operators import columns as cols
from foldcast.operators import rows
from tests.conftest import day, rows_of


@pytest.fixture
def mixed_text(spark):
    return spark.createDataFrame(
        [("1", "1", 1), ("2.5", "2", 2), ("x", " 3 ", 3), (None, None, 4), ("1.5d", "4e1", 5)],
        "a string, b string, c int",
    )


def test_force_numeric(mixed_text):
    out = cols.to_numeric(mixed_text)
    assert [r.a for r in out.orderBy("c").collect()] == [1.0, 2.5, None, None, None]
    assert [r.b for r in out.orderBy("c").collect()] == [1.0, 2.0, 3.0, None, 40.0]
    assert dict(out.dtypes)["c"] == "int"


def test_numeric_or_unchanged(mixed_text):
    out = cols.to_numeric(mixed_text, force=False)
    assert dict(out.dtypes) == {"a": "string", "b": "double", "c": "int"}


def test_nan_text_is_null(spark):
    df = spark.createDataFrame([("nan",), ("Infinity",), ("7",)], "a string")
    values = [r.a for r in cols.to_numeric(df).collect()]
    assert values == [None, float("inf"), 7.0]


def test_verify_and_remove(mixed_text):
    report = cols.verify_columns(mixed_text, [" a ", "b", "z"])
    assert report == {"not_in_table": ["c"], "not_in_data": ["z"]}
    assert cols.remove_columns(mixed_text, ["b", "absent"]).columns == ["a", "c"]


def test_drop_masks_reorder_rename(spark):
    df = spark.createDataFrame([(1, 0, 2, 3, 4)], "f int, y_mask int, y int, d int, b int")
    assert cols.drop_mask_columns(df).columns == ["f", "y", "d", "b"]
    ordered = cols.reorder_columns(df, ["y"], ["b"], ["d"], ["y_mask"])
    assert ordered.columns == ["b", "d", "y_mask", "y", "f"]
    with pytest.raises(ValueError):
        cols.reorder_columns(df, [])
    with pytest.raises(ValueError):
        cols.reorder_columns(df, ["nope"])
    assert cols.rename_columns(df, {"f": "g"}).columns[0] == "g"


def test_sort_rows(spark):
    df = spark.createDataFrame([(2, "a"), (1, "b"), (None, "c"), (1, "a")], "k int, s string")
    out = [tuple(r) for r in cols.sort_rows(df, ["k", "s", "absent"]).collect()]
    assert out == [(1, "a"), (1, "b"), (2, "a"), (None, "c")]


def test_nan_to_null_and_masks(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None)], "a double, b double")
    assert rows_of(cols.nan_to_null(df)) == [(None, 1.0), (2.0, None)]
    out = cols.complete_masks(df, ["a"])
    assert [r.a_mask for r in out.collect()] == [0, 0]
    assert cols.complete_masks(out, ["a"]).columns == out.columns


def test_known_numbers_many_columns(spark):
    wide = spark.range(5).select(*[F.col("id").cast("double").alias(f"c{i}") for i in range(40)])
    assert cols.known_numbers(wide, wide.columns).count() == 5


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, 2)], "`y.l1` int, z int")
    assert cols.reorder_columns(df, ["z"]).columns == ["z", "y.l1"]


def test_split_keeps_nulls_outside(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    for listed in ([1, 3], spark.createDataFrame([(1,), (3,), (None,)], "v int")):
        inside, outside = rows.split_by_values(df, "k", listed)
        assert rows_of(inside) == [(1,), (3,)]
        assert rows_of(outside) == [(None,), (2,)]


def test_listed_values_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    inside, _ = rows.split_by_values(spark.read.parquet(path), "id", [3, 4])
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [3,4])]" in plan


def test_days(daily_gap, panel_small):
    assert rows_of(rows.missing_days(daily_gap, "d")) == [
        (day("2008-02-29"),), (day("2009-07-01"),)
    ]
    assert rows.missing_days(panel_small, "d", ["entity"]).count() == 0
    report = rows.day_continuity(daily_gap, "d").head()
    assert (report.n_missing, report.n_repeated, report.consecutive) == (2, 0, False)
    full = rows.day_continuity(panel_small, "d", ["entity"])
    assert [r.consecutive for r in full.collect()] == [True] * 3


def test_repeated_days_are_reported(spark):
    df = spark.createDataFrame([(day("2020-01-01"),), (day("2020-01-01"),)], "d date")
    report = rows.day_continuity(df, "d").head()
    assert (report.n_rows, report.n_missing, report.n_repeated, report.consecutive) == (2, 0, 1, False)
    counted = df.distinct().withColumn("n", F.lit(2))
    assert rows.day_continuity(counted, "d", count="n").head() == report


def test_year_and_window(daily_full):
    assert rows.rows_of_years(daily_full, F.year("d"), [2007, 2008]).count() == 731
    assert rows.between_days(daily_full, "d", "2013-12-30").count() == 2
    assert rows.between_days(daily_full, "d", None, "2007-01-03").count() == 3
    assert rows.between_days(daily_full, "d").count() == daily_full.count()
