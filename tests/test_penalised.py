import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from foldcast.plans.models import fit_folds, fold_scores, model_steps
from foldcast.plans.penalised import JointLasso, SeasonalTrend, block_descent


def objective(x, y, w, penalty):
    rest = y - y.mean(0) - (x - x.mean(0)) @ w
    return (rest**2).sum() / (2 * len(x)) + (penalty * np.linalg.norm(w, axis=1)).sum()


def proximal(x, y, penalty, steps=40_000):
    """Another way to the same minimum: gradient steps and shrinking of rows."""
    x, y = x - x.mean(0), y - y.mean(0)
    gram, cross = x.T @ x / len(x), x.T @ y / len(x)
    rate = 1 / np.linalg.eigvalsh(gram).max()
    w = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(steps):
        w = w - rate * (gram @ w - cross)
        length = np.maximum(np.linalg.norm(w, axis=1), 1e-300)
        w *= np.maximum(0, 1 - rate * penalty / length)[:, None]
    return w


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.5, 50.0])
def test_descent_reaches_the_minimum(alpha):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    y = x @ rng.normal(size=(5, 2)) * [[1, 0.1]] + rng.normal(size=(200, 2))
    penalty = np.array([alpha, alpha, 0.0, alpha, 2 * alpha])
    cx, cy = x - x.mean(0), y - y.mean(0)
    w = block_descent(cx.T @ cx / 200, cx.T @ cy / 200, penalty)
    np.testing.assert_allclose(w, proximal(x, y, penalty), atol=1e-6)
    if alpha == 50.0:
        assert (w[[0, 1, 3, 4]] == 0).all() and (w[2] != 0).all()


def test_constant_and_repeated_columns_do_no_harm():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 1))
    x = np.hstack([x, np.ones((50, 1)), x])
    y = 3 * x[:, :1] + 1
    c = x - x.mean(0)
    for penalty in (np.zeros(3), np.array([0.1, 0.1, 0.1])):
        w = block_descent(c.T @ c / 50, c.T @ (y - y.mean(0)) / 50, penalty)
        assert np.isfinite(w).all() and w[1, 0] == 0


@pytest.fixture
def panel_rows(spark):
    return spark.range(400).selectExpr(
        "CAST(id % 2 AS INT) + 3 AS fold", "IF(id % 5 = 0, 'valid', 'train') AS split",
        "CAST(hash(id, 1) % 100 AS DOUBLE) / 10 AS a", "CAST(hash(id, 2) % 100 AS DOUBLE) / 10 AS `b.c`",
        "CAST(hash(id, 3) % 100 AS DOUBLE) / 10 AS z", "id",
    ).selectExpr("*", "2 * a + 0.5 * z + hash(id, 4) % 10 AS y", "a - `b.c` AS v").selectExpr(
        "fold", "split", "IF(id % 50 = 7, NULL, a) AS a", "`b.c`", "z", "y", "v")


def test_joint_lasso_of_all_folds(spark, panel_rows, tmp_path):
    features, targets = ["a", "b.c", "z"], ["y", "v"]
    predicted, models = fit_folds(panel_rows, features, "y", "joint_lasso", [3, 4], alpha=0.8, jointly=targets)
    for fold in (3, 4):
        pdf = panel_rows.where(f"fold = {fold} AND split = 'train'").toPandas().dropna()
        x, y = pdf[features].to_numpy(float), pdf[targets].to_numpy(float)
        w = proximal(x, y, np.full(3, 0.8))
        np.testing.assert_allclose(models[fold].stages[-1].coefficients, w[:, 0], atol=1e-6)
        want = y[:, 0].mean() + (x - x.mean(0)) @ w[:, 0]
        got = predicted.where(f"fold = {fold} AND split = 'train'").select("p").toPandas()["p"]
        np.testing.assert_allclose(sorted(got), sorted(want), atol=1e-6)
    assert {(r.fold, r.split) for r in fold_scores(predicted, "y").collect()} == {
        (f, s) for f in (3, 4) for s in ("train", "valid")}
    models[3].write().save(str(tmp_path / "m"))
    rows = panel_rows.where("fold = 3 AND a IS NOT NULL")
    again = PipelineModel.load(str(tmp_path / "m")).transform(rows)
    assert again.exceptAll(models[3].transform(rows)).count() == 0


def test_one_target_is_the_plain_lasso(panel_rows):
    rows = panel_rows.where("split = 'train' AND a IS NOT NULL")
    own = JointLasso("y", ["a", "z"], alpha=0.5).coefficients(rows)[1][:, 0]
    theirs = model_steps("lasso", ["a", "z"], "y", alpha=0.5).fit(rows).stages[-1].coefficients
    np.testing.assert_allclose(own, theirs, atol=1e-3)


def days(spark, noise=0.0):
    """Slope 1 a year, from day 400 on 5; a weekly term and a regressor."""
    return spark.range(1000).selectExpr(
        "date_add(DATE'1995-01-01', CAST(id AS INT)) AS d", "CAST(hash(id) % 10 AS DOUBLE) AS x", "id",
    ).selectExpr(
        "d", "x", f"10 + id / 365.25 + 4 * greatest(id - 400, 0) / 365.25 + 2 * sin(id * 2 * pi() / 7) + 0.3 * x "
        f"+ {noise} * (hash(id, 9) % 100) / 100 AS y")


def test_known_changepoints_are_fitted_exactly(spark):
    model = SeasonalTrend("y", ["x"], changepoints=["1996-02-05"], penalty=0.0, yearly=2)
    terms, w, b = model.coefficients(days(spark))
    found = dict(zip(terms, w[:, 0]))
    assert found["trend"] == pytest.approx(1, abs=1e-6) and found["bend1"] == pytest.approx(4, abs=1e-6)
    assert found["week_sin1"] == pytest.approx(2, abs=1e-6) and found["x"] == pytest.approx(0.3, abs=1e-6)
    assert b[0] == pytest.approx(10, abs=1e-6)


def test_many_candidates_leave_the_bend_that_is_there(spark):
    rows = days(spark, 0.5)
    model = SeasonalTrend("y", ["x"], changepoints=20, penalty=0.02, yearly=0)
    terms, w, _ = model.coefficients(rows)
    bends = {k: v for k, v in zip(terms, w[:, 0]) if k.startswith("bend")}
    used = {k for k, v in bends.items() if abs(v) > 0.05}
    assert len(bends) == 20 and "bend10" in used and len(used) <= 4  # the tenth lies at day 400
    fitted = model_steps("seasonal", ["x"], "y", changepoints=20, penalty=0.02, yearly=0).fit(rows)
    error = fitted.transform(rows).agg(F.avg(F.abs(F.col("p") - F.col("y")))).head()[0]
    assert error < 0.3


def test_seasonal_refuses_clashing_names_and_empty_rows(spark):
    rows = days(spark).withColumn("trend", F.lit(1.0))
    with pytest.raises(ValueError, match="trend"):
        SeasonalTrend("y", ["trend"]).coefficients(rows)
    with pytest.raises(ValueError, match="no rows"):
        SeasonalTrend("y", ["x"]).coefficients(rows.limit(0))
