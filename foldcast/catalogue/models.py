"""MLlib models per fold, and the search for features."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldcast.catalogue.common import (
    DAILY_SQL, FOLD_YEARS, FOLDS_SQL, PANEL_SQL, daily, ols_sql, panel, query, r, round_columns,
    table,
)
from foldcast.functions.metrics import REGRESSION_SCORES, poisson_rms, rmse
from foldcast.operators.folds import assign_folds, fold_table
from foldcast.operators.scores import mean_importance
from foldcast.operators.series import lag_days
from foldcast.plans import metadata as md
from foldcast.plans import workflow
from foldcast.plans.metadata import ColumnSpec, ColumnTable
from foldcast.plans.models import (
    apply_stored, fit_folds, fold_scores, importances, seasonal_terms,
)
from foldcast.plans.subset_search import backward_elimination, forward_selection as add_features
from foldcast.session import fresh_path, materialise
from foldcast.sources.layout import RunLayout

_SCORES = list(REGRESSION_SCORES)
_PANEL_FEATURES = ["y_d7", "y_d364", "weekday", "month", "summer"]


def daily_folds(spark, sf_dir):
    """Daily rows per fold with the calendar lag 7 and a weekend flag."""
    df = lag_days(daily(spark, sf_dir).select("d", "y"), ["y"], [7], "d")
    df = df.select(
        "d", F.col("y").cast("double").alias("y"), F.col("y_d7").cast("double").alias("x"),
        F.dayofweek("d").isin(1, 7).cast("double").alias("weekend"),
        F.dayofweek("d").cast("double").alias("weekday"),
    )
    year = F.year("d")
    # Read once per fold and per fit, so it is kept in the shared folder.
    return materialise(assign_folds(df, fold_table(df, year, FOLD_YEARS, 1), year), "daily_folds")


def panel_folds(spark, sf_dir):
    """Panel rows per fold with calendar lags and calendar features."""
    df = lag_days(panel(spark, sf_dir).select("entity", "d", "y"), ["y"], [7, 364], "d", ["entity"])
    df = df.withColumns(
        {
            "weekday": F.dayofweek("d"),
            "month": F.month("d"),
            "summer": F.month("d").isin(7, 8).cast("int"),
        }
    )
    year = F.year("d")
    return materialise(assign_folds(df, fold_table(df, year, FOLD_YEARS, 1), year), "panel_folds")


_DAILY_FOLDS_SQL = f"""WITH {DAILY_SQL}, {FOLDS_SQL}, rows AS (
  SELECT CAST(fold AS INTEGER) AS fold, split, a.d, CAST(a.y AS DOUBLE) AS y,
         CAST(b.y AS DOUBLE) AS x, dayofweek(a.d) IN (0, 6) AS weekend, dayofweek(a.d) AS weekday
  FROM daily a LEFT JOIN daily b ON a.d = b.d + 7 JOIN folds ON year(a.d) = year)"""
_MODEL_SCORES_SQL = (
    f"count(*) AS n, {r('avg(abs(y - p))', 4)} AS \"MAE\", "
    f"{r('-sqrt(avg((y - p) * (y - p)))', 4)} AS \"RMSE\", "
    f"{r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 4)} AS \"R2\""
)


@query(
    "linear_regression",
    f"""{_DAILY_FOLDS_SQL}, fit AS (
      SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM rows
      WHERE split = 'train' AND x IS NOT NULL GROUP BY 1)
    SELECT rows.fold, split, {_MODEL_SCORES_SQL}
    FROM (SELECT rows.*, a + b * x AS p FROM rows JOIN fit USING (fold) WHERE x IS NOT NULL) rows
    GROUP BY 1, 2""",
)
def linear_regression(spark, sf_dir):
    predicted, _ = fit_folds(daily_folds(spark, sf_dir), ["x"], "y", "linear", FOLD_YEARS)
    return round_columns(fold_scores(predicted, "y"), _SCORES, 4)


@query(
    "lasso",
    f"""{_DAILY_FOLDS_SQL}, fit AS (
      SELECT fold, sign(covar_pop(y, x)) * greatest(abs(covar_pop(y, x)) - 0.05, 0) / var_pop(x) AS b,
             avg(y) AS my, avg(x) AS mx FROM rows WHERE split = 'train' AND x IS NOT NULL GROUP BY 1)
    SELECT rows.fold, split, count(*) AS n, {r('avg(abs(y - p))', 2)} AS "MAE",
           {r('-sqrt(avg((y - p) * (y - p)))', 2)} AS "RMSE"
    FROM (SELECT rows.*, my + b * (x - mx) AS p FROM rows JOIN fit USING (fold)
          WHERE x IS NOT NULL) rows GROUP BY 1, 2""",
)
def lasso(spark, sf_dir):
    predicted, _ = fit_folds(
        daily_folds(spark, sf_dir), ["x"], "y", "lasso", FOLD_YEARS, alpha=0.05
    )
    return round_columns(fold_scores(predicted, "y"), ["MAE", "RMSE"], 2).drop("R2")


_JOINT_FEATURES, _JOINT_TARGETS, _JOINT_ALPHA = ("x", "weekend", "month"), ("y", "value"), 0.02


def _joint_lasso_sql(sweeps: int = 300) -> str:
    """Coordinate descent on covariances, one sweep per step of the recursion."""
    k, t = range(len(_JOINT_FEATURES)), range(len(_JOINT_TARGETS))
    moments = [f"covar_pop({_JOINT_FEATURES[i]}, {_JOINT_FEATURES[j]}) AS g{i}{j}" for i in k for j in k]
    moments += [f"covar_pop({_JOINT_FEATURES[i]}, {_JOINT_TARGETS[u]}) AS c{i}{u}" for i in k for u in t]
    moments += [f"avg({c}) AS m_{c}" for c in (*_JOINT_FEATURES, *_JOINT_TARGETS)]
    weights = [f"w{i}{u}" for i in k for u in t]
    inner = "descent JOIN m USING (fold)"
    step = f"SELECT fold, n, m.* EXCLUDE (fold), {', '.join(weights)} FROM {inner} WHERE n < {sweeps}"
    for i in k:
        pulls = ", ".join(
            f"c{i}{u} - ({' + '.join(f'g{i}{j} * w{j}{u}' for j in k if j != i)}) AS r{u}" for u in t
        )
        length = "sqrt(" + " + ".join(f"r{u} * r{u}" for u in t) + ")"
        new = ", ".join(f"greatest(0, 1 - {_JOINT_ALPHA} / {length}) * r{u} / g{i}{i} AS w{i}{u}" for u in t)
        gone = ", ".join([*(f"w{i}{u}" for u in t), *(f"r{u}" for u in t)])
        step = f"SELECT * EXCLUDE ({gone}), {new} FROM (SELECT *, {pulls} FROM ({step}))"
    fitted = " UNION ALL ".join(
        f"SELECT fold, split, '{target}' AS target, {target} AS y, m_{target} + "
        + " + ".join(f"w{i}{u} * ({f} - m_{f})" for i, f in enumerate(_JOINT_FEATURES))
        + f" AS p FROM rows JOIN fit USING (fold)" for u, target in enumerate(_JOINT_TARGETS)
    )
    return (
        f"WITH RECURSIVE {DAILY_SQL}, {FOLDS_SQL}, rows AS MATERIALIZED (SELECT CAST(fold AS INTEGER) AS fold, split, "
        "CAST(a.y AS DOUBLE) AS y, a.revenue / 100000 AS value, CAST(b.y AS DOUBLE) AS x, "
        "CASE WHEN dayofweek(a.d) IN (0, 6) THEN 1.0::DOUBLE ELSE 0 END AS weekend, CAST(month(a.d) AS DOUBLE) AS month "
        "FROM daily a JOIN daily b ON a.d = b.d + 7 JOIN folds ON year(a.d) = year), "
        f"m AS MATERIALIZED (SELECT fold, {', '.join(moments)} FROM rows WHERE split = 'train' GROUP BY 1), "
        f"descent AS (SELECT fold, 0 AS n, {', '.join(f'0.0::DOUBLE AS {w}' for w in weights)} FROM m UNION ALL "
        f"SELECT fold, n + 1, {', '.join(weights)} FROM ({step})), "
        f"fit AS MATERIALIZED (SELECT * FROM descent JOIN m USING (fold) WHERE n = {sweeps}), all_rows AS ({fitted}) "
        "SELECT fold, split, target, count(*) AS n, "
        f"{r('avg(abs(y - p))')} AS \"MAE\", {r('-sqrt(avg((y - p) * (y - p)))')} AS \"RMSE\", "
        f"{r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS \"R2\" FROM all_rows GROUP BY 1, 2, 3"
    )


@query("lasso_joint", _joint_lasso_sql())
def lasso_joint(spark, sf_dir):
    """Two targets under one penalty per feature."""
    df = lag_days(daily(spark, sf_dir).select("d", "y", "revenue"), ["y"], [7], "d").select(
        "d", F.col("y").cast("double").alias("y"), (F.col("revenue") / 100000).alias("value"),
        F.col("y_d7").cast("double").alias("x"), F.dayofweek("d").isin(1, 7).cast("double").alias("weekend"),
        F.month("d").cast("double").alias("month"),
    )
    year = F.year("d")
    rows = materialise(assign_folds(df, fold_table(df, year, FOLD_YEARS, 1), year), "joint_folds")
    out = None
    for target in _JOINT_TARGETS:
        predicted, _ = fit_folds(
            rows, _JOINT_FEATURES, target, "joint_lasso", FOLD_YEARS, alpha=_JOINT_ALPHA, jointly=_JOINT_TARGETS
        )
        scores = fold_scores(predicted, target).withColumn("target", F.lit(target))
        out = scores if out is None else out.unionByName(scores)
    return round_columns(out, _SCORES)


@query(
    "tree_regression",
    f"""{_DAILY_FOLDS_SQL}, fit AS (
      SELECT fold, weekday, avg(y) AS p FROM rows WHERE split = 'train' GROUP BY 1, 2)
    SELECT rows.fold, split, {_MODEL_SCORES_SQL}
    FROM rows JOIN fit USING (fold, weekday) GROUP BY 1, 2""",
)
def tree_regression(spark, sf_dir):
    predicted, _ = fit_folds(
        daily_folds(spark, sf_dir), ["weekday"], "y", "tree", FOLD_YEARS, max_depth=6
    )
    return round_columns(fold_scores(predicted, "y"), _SCORES, 4)


@query(
    "poisson_glm",
    f"""{_DAILY_FOLDS_SQL}, fit AS (
      SELECT fold, weekend, avg(y) AS p FROM rows WHERE split = 'train' GROUP BY 1, 2)
    SELECT rows.fold, split, {_MODEL_SCORES_SQL}
    FROM rows JOIN fit USING (fold, weekend) GROUP BY 1, 2""",
)
def poisson_glm(spark, sf_dir):
    predicted, _ = fit_folds(
        daily_folds(spark, sf_dir), ["weekend"], "y", "count", FOLD_YEARS, family="poisson"
    )
    return round_columns(fold_scores(predicted, "y"), _SCORES, 4)


@query(
    "gbt_regression",
    f"""{_DAILY_FOLDS_SQL}, fit AS (
      SELECT fold, weekday, avg(y) AS p FROM rows WHERE split = 'train' GROUP BY 1, 2)
    SELECT rows.fold, split, {_MODEL_SCORES_SQL}
    FROM rows JOIN fit USING (fold, weekday) GROUP BY 1, 2""",
)
def gbt_regression(spark, sf_dir):
    """On one feature with few values the first tree leaves only noise to the others."""
    predicted, _ = fit_folds(
        daily_folds(spark, sf_dir), ["weekday"], "y", "boosted", FOLD_YEARS, max_depth=6, rounds=3
    )
    return round_columns(fold_scores(predicted, "y"), _SCORES, 4)


@query("gbt_panel")
def gbt_panel(spark, sf_dir):
    predicted, _ = fit_folds(
        panel_folds(spark, sf_dir), _PANEL_FEATURES, "y", "boosted", FOLD_YEARS,
        max_depth=3, rounds=5,
    )
    return round_columns(fold_scores(predicted, "y"), _SCORES, 4)


@query(
    "panel_regression",
    f"""WITH {PANEL_SQL}, {FOLDS_SQL}, rows AS MATERIALIZED (
      SELECT CAST(fold AS INTEGER) AS fold, split, CAST(a.y AS DOUBLE) AS y, b.y AS y_d7,
             c.y AS y_d364, dayofweek(a.d) + 1 AS weekday, month(a.d) AS month,
             CASE WHEN month(a.d) IN (7, 8) THEN 1 ELSE 0 END AS summer
      FROM panel a JOIN panel b ON a.entity = b.entity AND a.d = b.d + 7
           JOIN panel c ON a.entity = c.entity AND a.d = c.d + 364
           JOIN folds ON year(a.d) = year),
    {ols_sql('rows', _PANEL_FEATURES, 'y', 'fitted')}
    SELECT fold, split, {_MODEL_SCORES_SQL} FROM fitted GROUP BY 1, 2""",
)
def panel_regression(spark, sf_dir):
    predicted, _ = fit_folds(
        panel_folds(spark, sf_dir), _PANEL_FEATURES, "y", "linear", FOLD_YEARS
    )
    return round_columns(fold_scores(predicted, "y"), _SCORES, 4)


def _term_sql() -> dict[str, str]:
    number = "CAST(date_diff('day', DATE '1995-01-01', d) AS DOUBLE)"
    terms = {"trend": f"{number} / 365.25::DOUBLE"}
    for name, period, order in (("week", "7.0", 3), ("year", "365.25", 10)):
        for k in range(1, order + 1):
            for f in ("sin", "cos"):
                terms[f"{name}_{f}{k}"] = f"{f}({number} * 2 * pi() * {k} / {period}::DOUBLE)"
    return terms


@query(
    "seasonal_regression",
    f"""WITH {DAILY_SQL}, {FOLDS_SQL}, rows AS MATERIALIZED (
      SELECT CAST(fold AS INTEGER) AS fold, split, CAST(y AS DOUBLE) AS y,
             {', '.join(f'{sql} AS {name}' for name, sql in _term_sql().items())}
      FROM daily JOIN folds ON year(d) = year),
    {ols_sql('rows', list(_term_sql()), 'y', 'fitted')}
    SELECT fold, split, {_MODEL_SCORES_SQL} FROM fitted GROUP BY 1, 2""",
)
def seasonal_regression(spark, sf_dir):
    df = daily(spark, sf_dir).select("d", "y")
    terms = seasonal_terms(F.col("d"))
    year = F.year("d")
    rows = materialise(
        assign_folds(df.withColumns(terms), fold_table(df, year, FOLD_YEARS, 1), year), "seasonal"
    )
    predicted, _ = fit_folds(rows, list(terms), "y", "linear", FOLD_YEARS)
    return round_columns(fold_scores(predicted, "y"), _SCORES, 4)


_BENDS = ("1995-07-01", "1996-07-01")


def _bent_term_sql() -> dict[str, str]:
    bends = {
        f"bend{k + 1}": f"greatest(date_diff('day', DATE '{date}', d), 0) / 365.25::DOUBLE" for k, date in enumerate(_BENDS)
    }
    return _term_sql() | bends | {"x": "x", "price": "price"}


@query(
    "seasonal_trend",
    f"""WITH {DAILY_SQL}, {FOLDS_SQL}, lagged AS (
      SELECT a.d, CAST(a.y AS DOUBLE) AS y, CAST(b.y AS DOUBLE) AS x, b.revenue / b.y / 100000 AS price
      FROM daily a JOIN daily b ON a.d = b.d + 7),
    rows AS MATERIALIZED (
      SELECT CAST(fold AS INTEGER) AS fold, split, y,
             {', '.join(f'{sql} AS {name}' for name, sql in _bent_term_sql().items())}
      FROM lagged JOIN folds ON year(d) = year),
    {ols_sql('rows', list(_bent_term_sql()), 'y', 'fitted')}
    SELECT fold, split, {_MODEL_SCORES_SQL} FROM fitted GROUP BY 1, 2""",
)
def seasonal_trend(spark, sf_dir):
    """Known changepoints, and two regressors: count and mean price of the week before."""
    df = lag_days(daily(spark, sf_dir).select("d", "y", "revenue"), ["y", "revenue"], [7], "d").select(
        "d", F.col("y").cast("double").alias("y"), F.col("y_d7").cast("double").alias("x"),
        (F.col("revenue_d7") / F.col("y_d7") / 100000).alias("price"),
    )
    year = F.year("d")
    rows = materialise(assign_folds(df, fold_table(df, year, FOLD_YEARS, 1), year), "trend_folds")
    predicted, _ = fit_folds(
        rows, ["x", "price"], "y", "seasonal", FOLD_YEARS, changepoints=list(_BENDS), penalty=0.0
    )
    return round_columns(fold_scores(predicted, "y"), _SCORES, 4)


@query(
    "model_scoring",
    f"""{_DAILY_FOLDS_SQL}, fit AS (
      SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM rows
      WHERE split = 'train' AND x IS NOT NULL GROUP BY 1)
    SELECT fold, split, count(*) AS n, {r('sqrt(avg((y - p) * (y - p)))', 4)} AS "RMSE",
           {r('sqrt(avg((y - p) * (y - p) / (y + 1)))', 4)} AS "PRMS"
    FROM (SELECT rows.*, a + b * x AS p FROM rows JOIN fit USING (fold) WHERE x IS NOT NULL)
    GROUP BY 1, 2""",
)
def model_scoring(spark, sf_dir):
    rows = daily_folds(spark, sf_dir)
    _, models = fit_folds(rows, ["x"], "y", "linear", FOLD_YEARS)
    predicted = None
    for fold, fitted in models.items():
        path = fresh_path(spark, "model")
        fitted.write().save(path)
        found = apply_stored(path, rows.where(F.col("fold") == fold), ["x"], "y")
        predicted = found if predicted is None else predicted.unionByName(found)
    out = fold_scores(predicted, "y", {"RMSE": rmse, "PRMS": poisson_rms})
    return round_columns(out, ["RMSE", "PRMS"], 4)


@query(
    "prediction_table",
    f"""{_DAILY_FOLDS_SQL}, fit AS (
      SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM rows
      WHERE split = 'train' AND x IS NOT NULL GROUP BY 1),
    known AS (SELECT rows.*, a + b * x AS p FROM rows JOIN fit USING (fold) WHERE x IS NOT NULL)
    SELECT fold, split, 'y' AS target, 'actual' AS series, d AS date, {r('y', 4)} AS value FROM known
    UNION ALL
    SELECT fold, split, 'y', 'linear', d, {r('p', 4)} FROM known""",
)
def prediction_table(spark, sf_dir):
    """Stored models of all folds, applied by the job that users run."""
    layout = RunLayout(fresh_path(spark, "run"))
    layout.write_folds(daily_folds(spark, sf_dir), "daily")
    columns = [ColumnSpec("d", operation=md.DATE), ColumnSpec("y", operation=md.TARGET), ColumnSpec("x")]
    ColumnTable.of(columns).write(spark, layout.columns("daily"), mode="overwrite")
    workflow.fit_dataset(spark, layout, "daily", "linear", FOLD_YEARS)
    out = workflow.predict_dataset(spark, layout, "daily", "linear", FOLD_YEARS)
    return round_columns(out.drop("dataset", "run"), ["value"], 4)


@query("feature_importance")
def feature_importance(spark, sf_dir):
    rows = panel_folds(spark, sf_dir)
    _, models = fit_folds(rows, _PANEL_FEATURES, "y", "tree", FOLD_YEARS, max_depth=4)
    out = mean_importance(importances(models, _PANEL_FEATURES, rows))
    return round_columns(out, ["importance"])


_LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _line_splits(spark, sf_dir):
    """Train on shipments before 2000, validate on the later ones."""
    df = table(spark, sf_dir, "lineitem").select(*_LINE_FEATURES, "l_extendedprice", "l_shipdate")
    late = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return df.withColumn("split", F.when(late, "valid").otherwise("train"))


def _search_sql(forward: bool) -> str:
    """Fit every subset of the features, then walk from step to step."""
    k = len(_LINE_FEATURES)
    chains, listed = [], []
    for mask in range(2**k):
        chosen = [f for i, f in enumerate(_LINE_FEATURES) if mask >> i & 1]
        chains.append(ols_sql("rows", chosen, "y", f"o{mask}", by="one"))
        listed.append(
            f"SELECT {mask} AS mask, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS score "
            f"FROM o{mask} WHERE split = 'valid'"
        )
    names = ", ".join(f"({1 << i}, '{f}')" for i, f in enumerate(_LINE_FEATURES))
    start = 0 if forward else 2**k - 1
    steps = [f"w0 AS (SELECT {start} AS mask, '' AS feature, 0.0::DOUBLE AS score)"]
    for step in range(1, k + 1):
        change = "|" if forward else "-"
        wanted = "= 0" if forward else "<> 0"
        steps.append(
            f"w{step} AS MATERIALIZED (SELECT s.mask, f.feature, s.score FROM w{step - 1} w, "
            f"features f, scores s WHERE (w.mask & f.bit) {wanted} AND s.mask = (w.mask {change} f.bit) "
            "ORDER BY s.score DESC, f.feature LIMIT 1)"
        )
    walked = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS step, feature, {r('score')} AS score FROM w{i}"
        for i in range(1, k + 1)
    )
    return (
        "WITH rows AS MATERIALIZED (SELECT 1 AS one, CASE WHEN l_shipdate >= DATE '2000-01-01' "
        f"THEN 'valid' ELSE 'train' END AS split, l_extendedprice AS y, {', '.join(_LINE_FEATURES)} "
        f"FROM lineitem), {', '.join(chains)}, scores AS MATERIALIZED ({' UNION ALL '.join(listed)}), "
        f"features(bit, feature) AS (VALUES {names}), {', '.join(steps)} {walked}"
    )


@query("forward_selection", _search_sql(forward=True))
def forward_selection(spark, sf_dir):
    out = add_features(_line_splits(spark, sf_dir), _LINE_FEATURES, "l_extendedprice")
    return round_columns(out, ["score"])


@query("backward_selection", _search_sql(forward=False))
def backward_selection(spark, sf_dir):
    out = backward_elimination(_line_splits(spark, sf_dir), _LINE_FEATURES, "l_extendedprice")
    return round_columns(out, ["score"])
