import math

import pytest
from pyspark.sql import functions as F

from foldcast.functions import dates, metrics, sampling, text
from foldcast.functions.special import lgamma
from foldcast.operators import scores as sc
from tests.conftest import day, rows_of


def test_lgamma(spark):
    xs = [0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 100.5, 1e4, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", lgamma(F.col("x")).alias("g")).collect():
        assert row.g == pytest.approx(math.lgamma(row.x), rel=1e-9, abs=1e-9)


def test_dates(spark):
    df = spark.createDataFrame([(day("2019-11-25"), "25.11.2019"), (day("1900-01-01"), "x")],
                               "d date, s string")
    out = df.select(
        dates.to_excel_day("d").alias("n"),
        dates.from_excel_day(dates.to_excel_day("d")).alias("back"),
        dates.parse_day("s").alias("parsed"),
        dates.display_day("d").alias("shown"),
        dates.first_of_year("d").alias("first"),
    ).collect()
    assert tuple(out[0]) == (43794, day("2019-11-25"), day("2019-11-25"), "25 Nov 19",
                             day("2019-01-01"))
    assert (out[1].n, out[1].parsed) == (2, None)


COUNTS = [(0.0, 0.5), (1.0, 1.0), (5.0, 7.0), (600.0, 590.0)]


def scored(spark, pairs, metrics_=metrics.SCORES, **kw):
    df = spark.createDataFrame(pairs, "y double, p double")
    return sc.score(df, F.col("y"), F.col("p"), [], metrics_, **kw).head()


def test_scores_by_hand(spark):
    got = scored(spark, [*COUNTS, (3.0, None), (None, 3.0)])
    n = len(COUNTS)
    assert got.n == n
    assert got.RMSE == pytest.approx(math.sqrt(sum((y - p) ** 2 for y, p in COUNTS) / n))
    assert got.PRMS == pytest.approx(
        math.sqrt(sum((y - p) ** 2 / (y + 1) for y, p in COUNTS) / n))
    assert got.RdMAPE == pytest.approx(sum(abs(y - p) / (y + 1) for y, p in COUNTS) / n)
    assert got.PdMAPE == pytest.approx(sum(abs(y - p) / max(y, 1) for y, p in COUNTS) / n)
    mean = sum(y for y, _ in COUNTS) / n
    total = sum((y - mean) ** 2 for y, _ in COUNTS)
    residual = sum((y - p) ** 2 for y, p in COUNTS)
    assert got.R2 == pytest.approx(1 - residual / (total + 1e-7))
    assert got.PLL == pytest.approx(
        sum(y * math.log(p) - p - math.lgamma(y + 1) for y, p in COUNTS) / n)


def test_likelihood_is_null_if_a_prediction_is_not_positive(spark):
    assert scored(spark, [*COUNTS, (2.0, 0.0)]).PLL is None
    assert scored(spark, [*COUNTS, (2.0, 0.0)], offsets={"PLL": 1.0}).PLL is not None


def test_regression_scores(spark):
    got = scored(spark, COUNTS, metrics.REGRESSION_SCORES)
    assert got.MAE == pytest.approx(13.5 / 4 - 1 / 4)
    assert got.RMSE < 0
    constant = scored(spark, [(1.0, 2.0), (1.0, 0.0)], metrics.REGRESSION_SCORES)
    assert constant.R2 is None


def test_losses(spark):
    df = spark.createDataFrame([(3.0, 1.0), (0.0, -1.0)], "y double, z double")
    row = df.agg(*[m(F.col("y"), F.col("z")).alias(n) for n, m in metrics.LOSSES.items()]).head()
    assert row.MSE == pytest.approx(((math.e - 3) ** 2 + math.exp(-1) ** 2) / 2)
    assert row.Poisson == pytest.approx((math.e - 3 + math.log(6) + math.exp(-1)) / 2)


def test_masks(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 1, 1), (5, 0, None)],
                               "y int, a int, b int")
    either = df.select(sc.unmasked(F.col("y"), F.col("a"), F.col("b")).alias("v"))
    assert [r.v for r in either.collect()] == [1, None, None, None, 5]
    both = df.select(sc.unmasked(F.col("y"), F.col("a"), F.col("b"), every=True).alias("v"))
    assert [r.v for r in both.collect()] == [1, 2, 3, None, 5]


def test_long_scores_and_summary(spark):
    df = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 3.0), ("k", 1, 5.0)],
                               "model string, fold int, RMSE double")
    long = sc.long_scores(df, ["RMSE"])
    assert long.columns == ["model", "fold", "metric", "value"]
    for folds in (None, [1, 2]):
        got = {r.model: r for r in sc.fold_summary(long, folds=folds).collect()}
        assert (got["m"]["1"], got["m"]["2"], got["m"].mean) == (1.0, 3.0, 2.0)
        assert got["m"].std == pytest.approx(math.sqrt(2))
        assert (got["k"]["2"], got["k"].std) == (None, None)


def test_weighted_loss(spark, caplog):
    df = spark.createDataFrame([(3.0, 1.0)], "y double, z double")
    pair = (F.col("y"), F.col("z"))
    got = sc.weighted_loss(df, {"a": pair, "b": pair}, " a = 2 ,other=9", "MSE").head()
    one = (math.e - 3) ** 2
    assert got.loss == pytest.approx(3 * one)
    assert "other" in caplog.text and "b" in caplog.text
    assert sc.weighted_loss(df, {"a": pair}, None, "MSE").head().loss == pytest.approx(one)


def test_mean_importance(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.0)],
                               "feature string, importance double")
    got = [tuple(r) for r in sc.mean_importance(df).collect()]
    assert got == [("a", pytest.approx(0.6), True), ("b", 0.0, False)]


def test_poisson_sample(spark):
    df = spark.range(20_000).selectExpr("id", "CASE id % 4 WHEN 0 THEN 3.0D WHEN 1 THEN 400.0D "
                                        "WHEN 2 THEN 5000.0D ELSE 0.0D END AS m")
    drawn = df.withColumn("p", sampling.poisson_sample(F.col("m"), ["id"], 7))
    for row in drawn.groupBy("m").agg(F.avg("p").alias("a"), F.var_pop("p").alias("v")).collect():
        error = 5 * math.sqrt(max(row.m, 1e-12) / 5000)
        assert abs(row.a - row.m) <= error
        assert row.v == pytest.approx(row.m, rel=0.1)
    again = df.repartition(5).withColumn("p", sampling.poisson_sample(F.col("m"), ["id"], 7))
    assert again.exceptAll(drawn).count() == 0
    other = df.withColumn("p", sampling.poisson_sample(F.col("m"), ["id"], 8))
    assert other.exceptAll(drawn).count() > 5000


def test_poisson_sample_of_null(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "id int, m double")
    got = rows_of(df.select("id", sampling.poisson_sample(F.col("m"), ["id"]).alias("p")))
    assert got[0] == (1, None) and got[1][1] is not None


def test_text(spark):
    names = ["x_c_m", "x_w_11_6003_l0", "x_w_12_6003_l0", "x_w_11_60034_l0", "y.l7", "y_l14", "z"]
    assert text.names_in_groups(names, ["calendar", "lagged"]) == ["x_c_m", "y.l7", "y_l14"]
    assert text.names_in_groups(names, ["basic_weather"], ["z", "z"]) == ["z", "x_w_11_6003_l0"]
    with pytest.raises(ValueError):
        text.names_in_groups(names, ["nothing"])
    short = {"lr": "lr", "layers": "l", "nesterov": "n", "name": "m"}
    assert text.run_name(short, lr=0.1, layers=[8, 4], nesterov=True, name=None) == "lr0.1_l8x4_n"
    assert text.run_name(short, nesterov=False) == ""
    df = spark.createDataFrame([(1, "a"), (2, None)], "lr int, name string")
    got = [r.r for r in df.select(text.run_name_column({"lr": "lr", "name": "m"}).alias("r")).collect()]
    assert got == ["lr1_ma", "lr2"]
    row = spark.range(1).select(text.weight_map(F.lit("a=1, b=0.5")).alias("w")).head()
    assert row.w == {"a": 1.0, "b": 0.5}


def test_poisson_draws_invert_the_distribution_at_any_mean(spark):
    """The k-th draw is the first count whose distribution function exceeds the uniform value."""
    import math

    from foldcast.functions.sampling import poisson_sample, uniform

    df = spark.range(400).selectExpr("id", "CAST(element_at(array(3, 499, 501, 20000), CAST(1 + id % 4 AS INT)) AS DOUBLE) AS mean")
    rows = df.select("mean", uniform(["id"], 7).alias("u"), poisson_sample(df["mean"], ["id"], 7).alias("k")).collect()
    for mean, u, k in rows:
        low = max(0, int(mean - 15 * math.sqrt(mean)))
        total = [math.exp(j * math.log(mean) - mean - math.lgamma(j + 1)) for j in range(low, int(k) + 1)]
        below, at = math.fsum(total[:-1]), math.fsum(total)
        assert below - 1e-9 <= u < at + 1e-9


def test_null_days_take_no_lag(spark):
    from foldcast.operators.series import lag_days, lag_days_joined, lagged_pairs

    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS DATE), 9.0D), (DATE '2020-01-02', 2.0D), (DATE '2020-01-01', 1.0D) t(d, y)")
    assert {r["y"]: r["y_d1"] for r in lag_days(df, ["y"], [1], "d").collect()} == {9.0: None, 2.0: 1.0, 1.0: None}
    assert {r["y"]: r["y_d1"] for r in lag_days_joined(df, ["y"], 1, "d").collect()} == {9.0: None, 2.0: 1.0, 1.0: None}
    assert {r["y"]: r["p"] for r in lagged_pairs(df, "y", [1], "d").collect()} == {9.0: None, 2.0: 1.0, 1.0: None}


def test_profiles_and_coercion_keep_types_apart(spark):
    from foldcast.operators.columns import to_numeric
    from foldcast.operators.encode import onehot
    from foldcast.operators.profile import column_profile

    df = spark.sql("SELECT 9007199254740992 + id AS big, DATE '2024-01-01' AS day, CAST(id AS STRING) AS text FROM range(3)")
    assert column_profile(df, ["big"]).first()["cardinality"] == 3
    out = to_numeric(df)
    assert dict(out.dtypes)["day"] == "date" and out.where("day IS NULL").count() == 0
    assert dict(out.dtypes)["text"] == "double"
    wide = spark.range(1500).selectExpr("id AS v")
    assert len(onehot(wide, ["v"])[0].columns) == 1500
