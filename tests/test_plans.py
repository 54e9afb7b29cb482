import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldcast.plans import headers as hd
from foldcast.plans import metadata as md
from foldcast.plans import models, preparation, subset_search, sweep
from foldcast.plans.metadata import ColumnSpec, ColumnTable
from tests.conftest import rows_of

TABLE = ColumnTable.of([
    ColumnSpec("d", operation=md.DATE, sort="asc10"),
    ColumnSpec("y", 0, operation=md.TARGET, normalisation=md.STD),
    ColumnSpec("junk", operation=md.REMOVE),
    ColumnSpec("cat", 7, operation=md.ONE_TO_MANY, sort="asc2"),
    ColumnSpec("q", 1, operation="onetomany:1:5", sort="ASC1"),
    ColumnSpec("x", 7, normalisation=md.MINMAX, null_value=md.MEAN, mean=1.0),
    ColumnSpec("w", None, null_value=md.ZERO, sort="desc1"),
])


def test_selection():
    assert TABLE.targets() == ["y"] and TABLE.date_column() == "d"
    assert TABLE.features() == ["cat", "x", "w"]
    assert TABLE.sort_columns() == ["q", "cat", "d"]
    assert TABLE.known_ahead(7) == ["cat", "x"]
    assert TABLE.known_ahead(1, "<=") == ["y", "q"] and TABLE.known_ahead(1, "==") == ["q"]
    assert TABLE.with_statistics() == ["x"]
    assert TABLE.normalised(md.MINMAX) == ["x"] and TABLE.null_policy(md.ZERO) == ["w"]
    assert TABLE.declared_ranges() == {"q": (1, 5)}
    with pytest.raises(ValueError):
        ColumnTable.of([]).date_column()


def test_table_changes():
    replaced = TABLE.replace_columns({"cat": ["cat_a", "cat_b"]})
    assert "cat" not in replaced.names and replaced.names[-2:] == ["cat_a", "cat_b"]
    lagged = TABLE.with_lags([1, 7], "{col}.l{n}")
    assert lagged.names[-2:] == ["y.l1", "y.l7"] and "y.l7" in lagged.features()
    assert lagged.specs[-1].normalisation == md.STD
    updated = TABLE.updated({"x": {"mean": 2.0, "std": None}, "absent": {"mean": 1.0}})
    assert updated.learnt()["x"].mean == 2.0 and TABLE.learnt()["x"].mean == 1.0


def test_table_file(spark, tmp_path):
    path = str(tmp_path / "columns")
    TABLE.write(spark, path)
    assert "Column Header;KnownDaysInAdvanced" in next(
        (tmp_path / "columns").glob("*.csv")).read_text()
    assert ColumnTable.read(spark, path) == TABLE


def test_profile_updates_the_table(spark):
    from foldcast.operators.profile import column_profile

    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    spec = {s.name: s for s in TABLE.updated_from(column_profile(df, ["x"])).specs}["x"]
    assert (spec.mean, spec.max, spec.cardinality, spec.nan_values) == (2.0, 3.0, 2, 0)


ROWS = [
    {"Column Header": "visits_6003_total", "Other": "a_6003", "Pseudonymisation": "Column Header, Other",
     "Pseudonymisation_Header_Operation": "Postcode-Indexing", "mean": 1.5},
    {"Column Header": "visits_6005_total", "Other": "b", "Pseudonymisation": "Column Header, Other",
     "Pseudonymisation_Header_Operation": "Postcode-Indexing"},
    {"Column Header": "rain_6003", "Other": "c", "Pseudonymisation": "Column Header, Other",
     "Pseudonymisation_Header_Operation": "Postcode-Indexing"},
    {"Column Header": "secret", "Other": "shown", "Pseudonymisation": "Other,Column Header",
     "Pseudonymisation_Header_Operation": "replace, open"},
    {"Column Header": "plain", "Other": "d", "Pseudonymisation": "Column Header",
     "Pseudonymisation_Header_Operation": None},
]


def test_headers():
    public = {h.original: h for h in hd.pseudonymise(hd.read_headers(ROWS), "salt")}
    places = {public["visits_6003_total"].name, public["visits_6005_total"].name}
    assert places == {"visits_Place0_total", "visits_Place1_total"}
    assert public["rain_6003"].name[-1] == public["visits_6003_total"].name[len("visits_Place")]
    assert public["shown"].name == "open" and public["shown"].description == "secret"
    assert public["plain"].name == "plain"
    assert hd.rename_map(list(public.values()))["plain"] == "plain"
    view = hd.public_view(list(public.values()))
    assert all("6003" not in str(row["ColumnName"]) for row in view)
    assert {row["mean"] for row in view} == {1.5, None}


@pytest.mark.parametrize("operation", ["unknown", "Postcode-Indexing,replace"])
def test_header_errors(operation):
    row = dict(ROWS[0], Pseudonymisation_Header_Operation=operation)
    with pytest.raises(ValueError):
        hd.pseudonymise(hd.read_headers([row]), "salt")


def test_header_without_code():
    for name in ("nothing", "a_6003_6004"):
        with pytest.raises(ValueError):
            hd.index_postcodes([hd.Header(name, name, None, hd.POSTCODE_INDEXING)], "s")


@pytest.fixture
def raw(spark):
    return spark.sql(
        "SELECT d, 10 + dayofyear(d) % 7 AS y, 1 AS junk, "
        "IF(day(d) = 1, NULL, IF(dayofweek(d) IN (1, 7), 'we', 'wd')) AS cat, quarter(d) AS q, "
        "IF(day(d) = 15, NULL, month(d) + year(d) - 2007) AS x, IF(day(d) = 2, NULL, 3) AS w "
        "FROM (SELECT explode(sequence(DATE '2007-01-01', DATE '2010-12-31')) AS d)")


def test_prepare_folds(raw):
    steps = preparation.Steps()
    prepared = preparation.prepare_folds(raw, TABLE, [2, 3], 1, lags=[7], steps=steps)
    rows = prepared.rows
    assert rows.columns == [
        "fold", "split", "d", "y", "x", "w", "cat_mask", "x_mask", "w_mask", "cat_wd", "cat_we",
        "q_1", "q_2", "q_3", "q_4", "y_l7"]
    assert set(steps.frames) == {"pre_split", "post_split"}
    train = rows.where("split = 'train'").groupBy("fold").agg(
        F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.min("x").alias("lo"),
        F.max("x").alias("hi"), F.avg("y_l7").alias("ml"))
    for r in train.collect():
        assert (r.m, r.s, r.lo, r.hi, r.ml) == pytest.approx((0, 1, -1, 1, 0), abs=1e-9)
    assert rows.where("fold = 2 AND split = 'valid'").agg(F.max("x")).head()[0] > 1  # not clipped
    assert rows.where("cat_wd + cat_we > 1 OR (cat_mask = 1 AND cat_wd + cat_we > 0)").count() == 0
    learnt = preparation.learnt_of_fold(prepared.statistics, 2)
    known = raw.where("year(d) < 2009").agg(F.avg("y"), F.stddev_pop("y")).head()
    assert (learnt["y"].mean, learnt["y"].std) == pytest.approx(tuple(known))
    assert "y_l7" in learnt and "cat_wd" in learnt
    spec = {s.name: s for s in prepared.table.specs}["cat_wd"]
    assert 0 < spec.mean < 1 and spec.max == 1.0


def test_validation_rows_do_not_change_the_training_rows(raw):
    """Learning on train only: other values after the cut leave train rows as they are."""
    table = ColumnTable.of([ColumnSpec("d", operation=md.DATE),
                            ColumnSpec("y", operation=md.TARGET, normalisation=md.STD)])
    plain = raw.select("d", "y")
    changed = plain.withColumn("y", F.when(F.year("d") < 2009, F.col("y")).otherwise(-99))
    a, b = (
        preparation.prepare_folds(df, table, [2], 1).rows.where("split = 'train'")
        for df in (plain, changed)
    )
    assert a.exceptAll(b).count() == 0 and a.count() == 731


def test_null_scope(spark):
    df = spark.createDataFrame(
        [(y, d, v) for y, d, v in [(2007, "2007-01-01", 1.0), (2007, "2007-01-02", 3.0),
                                   (2008, "2008-01-01", 9.0), (2008, "2008-01-02", None)]],
        "yy int, d string, v double").select(F.col("d").cast("date").alias("d"), "v")
    table = ColumnTable.of([ColumnSpec("d", operation=md.DATE),
                            ColumnSpec("v", normalisation=md.STD, null_value=md.MEAN)])
    for scope, expected in (("split", 7.0), ("train", 0.0)):
        rows, _ = preparation.apply_folds(df, table, [1], 1, scope)
        valid = rows.where("split = 'valid'").orderBy("d").collect()
        assert [r.v for r in valid] == pytest.approx([7.0, expected])
    with pytest.raises(ValueError):
        preparation.apply_folds(df, table, [1], 1, "other")


def test_excel_day_dates(spark):
    df = spark.createDataFrame([(39083, 1.0), (39448, 2.0)], "x_c_dat int, v double")
    table = ColumnTable.of([ColumnSpec("x_c_dat", operation=md.DATE), ColumnSpec("v")])
    rows, stats = preparation.apply_folds(df, table, [1], 1)
    assert rows_of(rows) == [(1, "train", 39083, 1.0), (1, "valid", 39448, 2.0)]
    assert stats.count() == 0


def test_year_column_is_added_once_and_decides_the_fold(spark):
    df = spark.createDataFrame([(39083, 1.0), (39448, 2.0), (None, 3.0)], "x_c_dat int, v double")
    dated = preparation.with_year(df, "x_c_dat")
    assert rows_of(dated, "v", "x_c_y") == [(1.0, 2007), (2.0, 2008), (3.0, None)]
    assert preparation.with_year(dated, "x_c_dat").columns == dated.columns
    # A business year that is not that of the date.
    own = df.where("v < 3").withColumn("x_c_y", F.lit(2010.0) - F.col("v"))
    table = ColumnTable.of([ColumnSpec("x_c_dat", operation=md.DATE), ColumnSpec("v")])
    rows, _ = preparation.apply_folds(own, table, [1], 1)
    assert rows_of(rows, "split", "v") == [("train", 2.0), ("valid", 1.0)]


def test_lag_features_normalised(panel_small):
    out = preparation.lag_features(panel_small, ["y"], [1], ["d"], ["entity"], normalised=True)
    row = out.agg(F.avg("y_l1"), F.count_if(F.col("y_l1").isNull())).head()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == 0
    plain = preparation.lag_features(panel_small, ["y"], [1], ["d"], ["entity"])
    first = plain.where("entity = 'e1'").orderBy("d").head()
    lagged = plain.where("y_l1 = y - 1").agg(F.avg("y_l1")).head()[0]
    assert first.y_l1 == pytest.approx(lagged)


def test_long_keys_are_lagged_in_chunks(panel_small):
    whole = preparation.lag_features(panel_small, ["y"], [3], ["d"], ["entity"])
    cut = preparation.lag_features(panel_small, ["y"], [3], ["d"], ["entity"], chunk_rows=9)
    assert rows_of(whole) == rows_of(cut.select(*whole.columns))


def test_grid_and_sweep(spark):
    runs = sweep.grid({"a": (0, 1), "b": (2, 3)})
    assert [r["run_id"] for r in runs] == [1, 2, 3, 4] and runs[2] == {"run_id": 3, "a": 1, "b": 2}
    df = spark.createDataFrame([("g", 5.0), ("g", 6.0), ("h", 1.0)], "g string, y double")
    scores = sweep.sweep_scores(df, F.col("y"), lambda r: F.lit(r["a"] + r["b"]), runs, ["g"])
    assert scores.count() == 8
    best = {r.g: r.run_id for r in sweep.best_run(scores, ["g"], "RMSE", highest=False).collect()}
    assert best == {"g": 4, "h": 1}
    ties = {r.g: r.run_id for r in sweep.best_run(scores, ["g"], "n").collect()}
    assert ties == {"g": 1, "h": 1}


@pytest.fixture
def regression(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)) * [1, 2, 5, 1] + [0, 100, 0, 1]
    y = 3 * x[:, 0] - x[:, 1] + 0.2 * x[:, 2] + rng.normal(size=400)
    rows = [(i, 1, "train" if i < 300 else "valid", *map(float, x[i]), float(y[i])) for i in range(400)]
    return spark.createDataFrame(
        rows, "id int, fold int, split string, a double, b double, c double, e double, y double")


def brute_force(pdf, names):
    train, valid = pdf[pdf.split == "train"], pdf[pdf.split == "valid"]
    design = lambda p: np.column_stack([np.ones(len(p)), *[p[n] for n in names]])
    w = np.linalg.lstsq(design(train), train.y, rcond=None)[0]
    residual = valid.y - design(valid) @ w
    return 1 - (residual**2).sum() / ((valid.y - valid.y.mean()) ** 2).sum()


@pytest.mark.parametrize("wide", [True, False])
def test_subset_scores_equal_refitting(regression, wide, monkeypatch):
    if wide:
        monkeypatch.setattr(subset_search, "_NATIVE_WIDTH", 0)
    names = ["a", "b", "c", "e"]
    found = subset_search.moments(regression, names, "y")
    pdf = regression.toPandas()
    for k in range(5):
        for chosen in itertools.combinations(range(4), k):
            got = subset_search.subset_r2(found["train"], found["valid"], chosen)
            assert got == pytest.approx(brute_force(pdf, [names[i] for i in chosen]), rel=1e-6)


def test_greedy_search(regression):
    names = ["e", "a", "c", "b"]
    pdf = regression.toPandas()
    steps = subset_search.forward_selection(regression, names, "y").orderBy("step").collect()
    chosen: list = []
    for s in steps:
        best = max((n for n in names if n not in chosen), key=lambda n: brute_force(pdf, [*chosen, n]))
        chosen.append(best)
        assert s.feature == best and s.score == pytest.approx(brute_force(pdf, chosen))
    left = list(names)
    for s in subset_search.backward_elimination(regression, names, "y").orderBy("step").collect():
        scores = {n: brute_force(pdf, [m for m in left if m != n]) for n in left}
        assert s.score == pytest.approx(max(scores.values()))
        left.remove(s.feature)
    assert left == []


def test_models(regression, tmp_path):
    names = ["a", "b", "c", "e"]
    pdf = regression.toPandas()
    for model, settings in (("linear", {}), ("lasso", {"alpha": 0.01}), ("tree", {"max_depth": 3}),
                            ("boosted", {"rounds": 2, "max_depth": 2})):
        predicted, fitted = models.fit_folds(regression, names, "y", model, [1], **settings)
        got = {r.split: r for r in models.fold_scores(predicted, "y").collect()}
        assert got["train"].n == 300 and got["valid"].n == 100 and got["valid"].RMSE < 0
        if model == "linear":
            assert got["valid"].R2 == pytest.approx(brute_force(pdf, names), rel=1e-6)
            path = str(tmp_path / "model")
            fitted[1].write().save(path)
            stored = models.apply_stored(path, regression, names, "y")
            assert models.fold_scores(stored, "y").orderBy("split").collect() == sorted(got.values(), key=lambda r: r.split)
    weights = models.importances(fitted, names, regression)
    assert weights.agg(F.sum("importance")).head()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        models.model_steps("nothing", names, "y")


def test_null_features_are_left_out(regression):
    holes = regression.withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    predicted, _ = models.fit_folds(holes, ["a"], "y", "linear", [1])
    assert predicted.count() == 360
