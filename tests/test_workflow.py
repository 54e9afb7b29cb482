import pytest
from pyspark.sql import functions as F

from foldcast.operators.folds import shuffled_copies
from foldcast.plans import metadata as md
from foldcast.plans import workflow
from foldcast.plans.metadata import ColumnSpec, ColumnTable
from foldcast.sources.layout import RunLayout
from tests.conftest import rows_of


@pytest.fixture
def layout(tmp_path):
    return RunLayout(str(tmp_path))


@pytest.fixture
def visits(spark):
    return spark.sql(
        "SELECT d, 20 + 5 * dayofweek(d) + month(d) + pmod(hash(d), 3) AS y, "
        "CAST(dayofweek(d) AS DOUBLE) AS x_c_wd, CAST(month(d) AS DOUBLE) AS x_c_m, "
        "CAST(pmod(hash(d, 1), 10) AS DOUBLE) AS x_w_rain "
        "FROM (SELECT explode(sequence(DATE '2007-01-01', DATE '2010-12-31')) AS d)")


TABLE = ColumnTable.of([
    ColumnSpec("d", operation=md.DATE, sort="asc1"),
    ColumnSpec("y", operation=md.TARGET),
    ColumnSpec("x_c_wd", normalisation=md.STD),
    ColumnSpec("x_c_m", normalisation=md.MINMAX),
    ColumnSpec("x_w_rain", normalisation=md.STD),
])


def test_prepare_fit_evaluate_report(spark, layout, visits):
    prepared = workflow.prepare_dataset(visits, TABLE, layout, "ds", [2, 3], 1, lags=[7])
    stored = layout.read_folds(spark, "ds", [7])
    assert stored.count() == prepared.rows.count()
    assert ColumnTable.read(spark, layout.columns("ds", [7])).names[-1] == "y_l7"

    scores, weights = workflow.fit_dataset(spark, layout, "ds", "linear", [2, 3], lags=[7])
    got = {(r.fold, r.split, r.metric): r.value for r in scores.collect()}
    assert len(got) == 12 and got[2, "valid", "R2"] > 0.9
    assert {r.feature for r in weights.collect()} == {"x_c_wd", "x_c_m", "x_w_rain", "y_l7"}

    again = workflow.evaluate_dataset(
        spark, layout, "ds", "linear", [2, 3], lags=[7], metrics={"R2": workflow.SCORES["R2"]})
    row = again.where("split = 'valid'").head()
    assert row["2"] == pytest.approx(got[2, "valid", "R2"], abs=1e-6)
    assert row.mean == pytest.approx((row["2"] + row["3"]) / 2)

    report = workflow.score_report(spark, layout, "ds")
    assert report.count() == 6 and {"2", "3", "mean", "std"} <= set(report.columns)


def test_runs_stay_apart(spark, layout, visits):
    """Two lag sets, two valid lengths and two settings of a model."""
    for lags, valid in (([], 1), ([7], 1), ([], 2)):
        workflow.prepare_dataset(visits, TABLE, layout, "ds", [2], valid, lags=lags)
    rows = {v: layout.read_folds(spark, "ds", valid_years=v).where("split = 'valid'").count() for v in (1, 2)}
    assert rows == {1: 365, 2: 730} and "y_l7" in layout.read_folds(spark, "ds", [7]).columns
    tagged = spark.read.parquet(layout.statistics).groupBy("lags_tag", "valid_years").count()
    assert tagged.count() == 3
    for depth in (1, 3, 3):
        workflow.fit_dataset(spark, layout, "ds", "tree", [2], max_depth=depth)
    workflow.fit_dataset(spark, layout, "ds", "tree", [2], valid_years=2, max_depth=3)
    report = workflow.score_report(spark, layout, "ds")
    assert report.select("run").distinct().count() == 3 and report.count() == 18
    assert report.where("mean <> `2`").count() == 0


def test_predictions_cover_rows_without_target(spark, layout, visits):
    open_ = visits.withColumn("y", F.when(F.col("d") < "2010-12-01", F.col("y")))
    table = ColumnTable.of([ColumnSpec("d", operation=md.DATE), ColumnSpec("y", operation=md.TARGET), ColumnSpec("x_c_wd")])
    rows = open_.select(
        F.lit(3).alias("fold"), F.when(F.year("d") < 2010, "train").otherwise("valid").alias("split"), "d", "y", "x_c_wd")
    layout.write_folds(rows, "ds")
    table.write(spark, layout.columns("ds"), mode="overwrite")
    workflow.fit_dataset(spark, layout, "ds", "linear", [3])
    for _ in range(2):  # a second run replaces the first
        out = workflow.predict_dataset(spark, layout, "ds", "linear", [3])
    got = {(r.split, r.series): (r.rows, r.known) for r in out.groupBy("split", "series").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("known")).collect()}
    assert got == {("train", "actual"): (1096, 1096), ("train", "linear"): (1096, 1096),
                   ("valid", "actual"): (365, 334), ("valid", "linear"): (365, 365)}


def test_feature_groups_and_fakes(spark, layout, visits):
    workflow.prepare_dataset(visits, TABLE, layout, "ds", [3], 1)
    _, weights = workflow.fit_dataset(
        spark, layout, "ds", "tree", [3], groups=["calendar"], fakes=True, max_depth=5)
    got = {r.feature: r.importance for r in weights.collect()}
    assert set(got) == {"x_c_wd", "x_c_m", "x_c_wd_fake", "x_c_m_fake"}
    assert got["x_c_wd"] > 0.8 and got["x_c_wd_fake"] < 0.1
    with pytest.raises(ValueError):
        workflow.fit_dataset(spark, layout, "ds", "tree", [3], features=["absent"])


def test_shuffled_copies_stay_within_their_group(spark):
    df = spark.range(600).selectExpr(
        "IF(id < 200, 0, 1 + id % 4) AS g", "id", "IF(id < 200, -id, id) AS v")
    out = shuffled_copies(df, ["v"], ["g", "id"], within=["g"])
    assert out.columns == ["g", "id", "v", "v_fake"]
    assert rows_of(out.select("g", "v")) == rows_of(out.select("g", F.col("v_fake").alias("v")))
    assert out.where("v <> v_fake").count() > 500
