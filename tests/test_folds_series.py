import math

import pytest
from pyspark.sql import functions as F

from foldcast.operators import folds as fo
from foldcast.operators import series
from foldcast.plans import baselines
from tests.conftest import day, rows_of


def test_fold_table(daily_full):
    table = fo.fold_table(daily_full, F.year("d"), [4, 6, 7], 1)
    got = rows_of(table.where("fold = 4"))
    assert got == sorted([(4, "train", y, True) for y in range(2007, 2011)]
                         + [(4, "valid", 2011, True)])
    assert table.where("fold = 7 AND split = 'valid'").count() == 0
    assert [r.complete for r in table.select("fold", "complete").distinct().orderBy("fold").collect()
            ] == [True, True, False]


def test_folds_hold_the_expected_consecutive_days(daily_full):
    """Each split of each fold runs from its first to its last day without a gap."""
    from foldcast.operators.rows import day_continuity

    year = F.year("d")
    rows = fo.assign_folds(daily_full, fo.fold_table(daily_full, year, [4, 5, 6], 1), year)
    report = {(r.fold, r.split): r for r in day_continuity(rows, "d", ["fold", "split"]).collect()}
    for n in (4, 5, 6):
        train, valid = report[n, "train"], report[n, "valid"]
        assert train.consecutive and valid.consecutive
        assert (train.first_day, train.last_day) == (day("2007-01-01"), day(f"{2006 + n}-12-31"))
        assert (valid.first_day, valid.last_day) == (day(f"{2007 + n}-01-01"), day(f"{2007 + n}-12-31"))


def test_fold_day_check_finds_lost_days(daily_full):
    """Days lost at an end of a split or a whole year in it show; nothing is seen as a gap otherwise."""
    folds = fo.fold_table(daily_full, F.year("d"), [4, 5], 1)
    full = {(r.fold, r.split): r for r in fo.fold_day_check(daily_full, folds, "d").collect()}
    assert len(full) == 4 and all(r.complete for r in full.values())
    assert full[4, "train"].n_expected == full[4, "train"].n_rows == 1461
    cut = daily_full.where("d <> '2007-01-01' AND year(d) <> 2011").unionByName(daily_full.where("d = '2008-05-05'"))
    got = {(r.fold, r.split): r for r in fo.fold_day_check(cut, folds, "d").collect()}
    assert (got[4, "train"].n_days, got[4, "train"].n_rows, got[4, "train"].complete) == (1460, 1461, False)
    assert (got[4, "valid"].n_days, got[4, "valid"].n_rows, got[4, "valid"].complete) == (0, 0, False)
    assert not got[5, "train"].complete and got[5, "valid"].complete


@pytest.mark.parametrize("size,end", [(0.2, True), (0.33, False), (0.0, True), (1.0, True)])
def test_ordered_split(daily_full, size, end):
    n = daily_full.count()
    out = fo.ordered_split(daily_full, ["d"], size, end).orderBy("d").collect()
    test = math.ceil(n * size)
    labels = [r.split for r in out]
    expected = (["train"] * (n - test) + ["test"] * test) if end else (
        ["test"] * test + ["train"] * (n - test))
    assert labels == expected


def test_split_is_a_filter(daily_full, spark, tmp_path):
    path = str(tmp_path / "t")
    daily_full.write.parquet(path)
    out = fo.ordered_split(spark.read.parquet(path), ["d"], 0.2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_ordered_split_per_key(skewed):
    out = fo.ordered_split(skewed, ["t"], 0.25, keys=["key"])
    per_key = out.groupBy("key").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("test"),
        F.max(F.when(F.col("split") == "train", F.col("t"))).alias("a"),
        F.min(F.when(F.col("split") == "test", F.col("t"))).alias("b"),
    )
    assert per_key.where("test <> ceil(n * 0.25) OR a >= b").count() == 0


def test_random_split(skewed):
    one = fo.random_split(skewed, ["t"], 0.3, seed=1)
    assert one.where("split = 'test'").count() == 900
    again = fo.random_split(skewed.repartition(7), ["t"], 0.3, seed=1)
    assert one.exceptAll(again).count() == 0
    assert one.exceptAll(fo.random_split(skewed, ["t"], 0.3, seed=2)).count() > 100
    with pytest.raises(ValueError):
        fo.random_split(skewed, ["t"], 2)


def test_shuffled_copies(skewed):
    out = fo.shuffled_copies(skewed, ["v", "key"], ["t"], seed=3)
    assert out.columns == ["key", "t", "v", "v_fake", "key_fake"]
    assert rows_of(out.select("v")) == rows_of(out.select("v_fake"))
    assert rows_of(out.select("key")) == rows_of(out.select("key_fake"))
    assert out.where("v <> v_fake").count() > 2500
    assert abs(out.stat.corr("key", "key_fake")) < 0.1


def test_day_lag_against_row_lag(daily_gap):
    """They differ where a day is missing, and both day forms agree."""
    from foldcast.operators.ordered import lag_rows

    by_day = series.lag_days(daily_gap, ["y"], [7], "d")
    joined = series.lag_days_joined(daily_gap, ["y"], 7, "d")
    assert rows_of(by_day) == rows_of(joined.select(*by_day.columns))
    pairs = series.lagged_pairs(daily_gap, "y", [7], "d")
    assert rows_of(pairs.select("d", "p")) == rows_of(
        by_day.select("d", F.col("y_d7").cast("double").alias("p")))
    assert by_day.where("d = DATE '2008-03-07'").head().y_d7 is None
    by_row = lag_rows(daily_gap, ["y"], [7], ["d"], chunk_rows=None)
    differ = by_day.join(by_row.select("d", "y_l7"), "d").where("NOT (y_d7 <=> y_l7)")
    assert differ.count() > 0


def test_running_mean_excludes_the_row_and_masked_rows(spark):
    df = spark.createDataFrame(
        [(day("2020-01-01"), 2, 0), (day("2020-01-02"), 100, 1), (day("2020-01-03"), 4, 0),
         (day("2020-01-04"), 9, 0)], "d date, y int, m int")
    out = df.select("d", series.running_mean(F.col("y"), "d", [], F.col("m")).alias("p"))
    assert [r.p for r in out.orderBy("d").collect()] == [None, 2.0, 2.0, 3.0]


@pytest.fixture
def masked(spark):
    """Masks on a value and on a lagged value."""
    return spark.createDataFrame(
        [(day("2020-01-01"), 2, 0), (day("2020-01-02"), 4, 1), (day("2020-01-03"), 5, 0),
         (day("2020-01-04"), 9, 0), (day("2020-01-05"), 1, 1), (day("2020-01-06"), 3, 1)],
        "d date, y int, m int")


def test_baseline_masks(masked):
    out = baselines.baseline_predictions(masked, "y", "d", mask="m", lags=[1])
    lag = out.where("model = 'lag 1' AND y IS NOT NULL AND p IS NOT NULL")
    assert rows_of(lag, "y", "p") == [(9.0, 5.0)]
    loose = baselines.baseline_predictions(masked, "y", "d", mask="m", lags=[1],
                                           mask_needs_both=True)
    lag = loose.where("model = 'lag 1' AND y IS NOT NULL AND p IS NOT NULL")
    assert rows_of(lag, "y", "p") == [(1.0, 9.0), (4.0, 2.0), (5.0, 4.0), (9.0, 5.0)]


def test_baseline_offsets(masked):
    out = baselines.baseline_predictions(masked, "y", "d", lags=[1])
    plain = baselines.baseline_scores(out, "d").where("model = 'lag 1'").head()
    carried = baselines.baseline_scores(out, "d", carried_offsets=True).where("model = 'lag 1'").head()
    assert plain.RMSE == carried.RMSE and plain.PRMS == carried.PRMS
    assert plain.R2 != carried.R2 and plain.PLL != carried.PLL


def test_noise_floor_scores_about_one(spark):
    df = spark.sql("SELECT d, 400 AS y FROM "
                   "(SELECT explode(sequence(DATE '2000-01-01', DATE '2009-12-31')) AS d)")
    out = baselines.baseline_predictions(df, "y", "d", lags=[], noise_seed=1)
    row = baselines.baseline_scores(out.where("model = 'noise'").withColumn("p", F.col("p") - 1), "d"
                                    ).agg(F.avg("PRMS")).head()
    assert row[0] == pytest.approx(1.0, abs=0.05)


def test_no_future_value_is_used(daily_full):
    """Change what comes after a day: the predictions up to that day stay the same."""
    cut = "2010-06-30"
    changed = daily_full.withColumn("y", F.when(F.col("d") <= cut, F.col("y")).otherwise(F.col("y") * 50))
    before = baselines.baseline_predictions(daily_full, "y", "d", lags=[1, 7, 364])
    after = baselines.baseline_predictions(changed, "y", "d", lags=[1, 7, 364])
    a, b = (x.where(F.col("d") <= cut).select("d", "model", "p") for x in (before, after))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_mean_model(spark):
    by_year = spark.createDataFrame([("a", 2007, 2, 10), ("a", 2008, 2, 30), ("b", 2007, 1, 0)],
                                    "entity string, year int, n long, total long")
    folds = fo.folds_of_years(spark, [2007, 2008], [1, 2], 1)
    got = {(r.entity, r.fold): r.intercept for r in
           baselines.mean_model(by_year, folds, ["entity"]).collect()}
    assert got["a", 1] == pytest.approx(math.log(5)) and got["a", 2] == pytest.approx(math.log(10))
    assert got["b", 1] is None
