"""Naive forecasts, scores, losses and the parameter sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldcast.catalogue.common import (
    DAILY_SQL, FOLD_YEARS, FOLDS_SQL, LAGS, PANEL_SQL, daily, metric_sql, panel, query, r,
    round_columns, scores_sql, table, with_mask,
)
from foldcast.functions.metrics import (
    BASELINE_OFFSETS, LOSSES, REGRESSION_SCORES, SCORES, poisson_rms, rmse,
)
from foldcast.functions.sampling import poisson_sample
from foldcast.functions.text import run_name_column
from foldcast.operators import scores as sc
from foldcast.operators.folds import fold_table
from foldcast.operators.series import day_lag, lag_days, lagged_pairs, running_mean
from foldcast.plans.baselines import baseline_predictions, baseline_scores as score_baselines, mean_model
from foldcast.plans.sweep import best_run as pick_best, grid, sweep_scores
from foldcast.session import checked_broadcast, materialise

_NO_PLL = {k: v for k, v in SCORES.items() if k != "PLL"}
_OFFSET_SQL = {"PRMS": "1.0::DOUBLE", "PLL": "1.0::DOUBLE"}

_LAG_PREDICTIONS_SQL = " UNION ALL ".join(
    f"SELECT 'lag {n}' AS model, a.d, CASE WHEN a.y_mask = 0 AND coalesce(b.y_mask, 0) = 0 "
    f"THEN CAST(a.y AS DOUBLE) END AS y, CAST(b.y AS DOUBLE) AS p "
    f"FROM daily a LEFT JOIN daily b ON a.d = b.d + {n}"
    for n in LAGS
)


@query(
    "baseline_scores",
    f"""WITH {DAILY_SQL}, preds AS (
      SELECT 'mean' AS model, d, CASE WHEN y_mask = 0 THEN CAST(y AS DOUBLE) END AS y,
             avg(CASE WHEN y_mask = 0 THEN y END) OVER (ORDER BY d
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM daily
      UNION ALL {_LAG_PREDICTIONS_SQL})
    SELECT model, CAST(year(d) AS INTEGER) AS year, {scores_sql(offsets=_OFFSET_SQL, pll=True)}
    FROM preds WHERE year(d) >= (SELECT year(min(d)) + 2 FROM daily) GROUP BY 1, 2""",
)
def baseline_scores(spark, sf_dir):
    """Test years are all from the third year of the data on."""
    start = table(spark, sf_dir, "orders").agg(F.year(F.min("o_orderdate"))).first()[0]
    predictions = baseline_predictions(daily(spark, sf_dir), "y", "d", mask="y_mask", lags=LAGS)
    out = score_baselines(predictions, "d", first_year=None if start is None else start + 2)
    return round_columns(out, list(SCORES))


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT {n} AS lag, a.d, CAST(a.y AS DOUBLE) AS y, CAST(b.y AS DOUBLE) AS p "
    f"FROM daily a LEFT JOIN daily b ON a.d = b.d + {n}"
    for n in LAGS
)


def _lag_scores(spark, sf_dir):
    pairs = lagged_pairs(daily(spark, sf_dir), "y", LAGS, "d")
    return sc.score(
        pairs.withColumn("year", F.year("d")), F.col("y"), F.col("p"), ["lag", "year"], _NO_PLL,
        BASELINE_OFFSETS,
    )


@query(
    "lag_baseline",
    f"WITH {DAILY_SQL}, pairs AS ({_PAIRS_SQL}) SELECT CAST(lag AS INTEGER) AS lag, "
    f"CAST(year(d) AS INTEGER) AS year, {scores_sql(offsets=_OFFSET_SQL)} FROM pairs GROUP BY 1, 2",
)
def lag_baseline(spark, sf_dir):
    return round_columns(_lag_scores(spark, sf_dir), list(_NO_PLL))


_YEARS = (1997, 1998, 1999, 2000, 2001)


@query(
    "fold_score_summary",
    f"WITH {DAILY_SQL}, pairs AS ({_PAIRS_SQL}), s AS (SELECT CAST(lag AS INTEGER) AS lag, "
    "CAST(year(d) AS INTEGER) AS year, "
    + ", ".join(f"{sql} AS \"{k}\"" for k, sql in metric_sql(offsets=_OFFSET_SQL).items())
    + f" FROM pairs WHERE year(d) BETWEEN {_YEARS[0]} AND {_YEARS[-1]} GROUP BY 1, 2), long AS ("
    + " UNION ALL ".join(
        f"SELECT lag, year, '{k}' AS metric, \"{k}\" AS value FROM s" for k in _NO_PLL
    )
    + ") SELECT lag, metric, "
    + ", ".join(f"{r(f'max(value) FILTER (WHERE year = {y})')} AS \"{y}\"" for y in _YEARS)
    + f", {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std FROM long GROUP BY 1, 2",
)
def fold_score_summary(spark, sf_dir):
    long = sc.long_scores(
        _lag_scores(spark, sf_dir).where(F.col("year").between(_YEARS[0], _YEARS[-1])).drop("n"),
        list(_NO_PLL),
    )
    out = sc.fold_summary(long, ["lag", "metric"], "year", _YEARS)
    return round_columns(out, [*map(str, _YEARS), "mean", "std"])


@query(
    "mean_baseline",
    f"""WITH {PANEL_SQL}, {FOLDS_SQL}, fit AS (
      SELECT entity, fold, ln(avg(y)) AS intercept FROM panel JOIN folds ON year(d) = year
      WHERE split = 'train' GROUP BY 1, 2)
    SELECT fit.entity, CAST(fit.fold AS INTEGER) AS fold, {r('any_value(intercept)')} AS intercept,
           count(*) AS n, {r(metric_sql(p='exp(intercept)')['RMSE'])} AS "RMSE",
           {r(metric_sql(p='exp(intercept)')['PRMS'])} AS "PRMS"
    FROM panel JOIN folds ON year(d) = year JOIN fit ON fit.entity = panel.entity
         AND fit.fold = folds.fold WHERE split = 'valid' GROUP BY 1, 2""",
)
def mean_baseline(spark, sf_dir):
    # Three steps read the panel, which is far smaller than the orders: keep it.
    df = materialise(panel(spark, sf_dir).withColumn("year", F.year("d")), "panel")
    folds = fold_table(df, F.col("year"), FOLD_YEARS, 1)
    by_year = df.groupBy("entity", "year").agg(
        F.count("y").alias("n"), F.sum("y").alias("total")
    )
    fitted = mean_model(by_year, folds, ["entity"])
    valid = folds.where("split = 'valid'").select("fold", "year")
    scored = df.join(F.broadcast(valid), "year").join(fitted, ["entity", "fold"])
    out = sc.score(
        scored, F.col("y").cast("double"), F.exp("intercept"), ["entity", "fold", "intercept"],
        {"RMSE": rmse, "PRMS": poisson_rms},
    )
    return round_columns(out, ["intercept", "RMSE", "PRMS"])


_DRAWS_SQL = """u AS (
      SELECT d, CAST(y AS DOUBLE) AS y,
             ('0x' || substr(md5(CAST(d AS VARCHAR) || '|42'), 1, 13))::BIGINT
               / 4503599627370496.0::DOUBLE AS u FROM daily),
    terms AS (
      SELECT d, y, u, k, exp(k * ln(y) - y - lgamma(k + 1.0::DOUBLE)) AS pmf
      FROM u, (SELECT CAST(range AS DOUBLE) AS k FROM range(0, 900)) ks
      WHERE k <= y + 12 * sqrt(y) + 30),
    cdf AS (
      SELECT d, y, u, k, sum(pmf) OVER (PARTITION BY d ORDER BY k) AS upto FROM terms),
    draws AS (SELECT d, y, min(k) AS p FROM cdf WHERE upto > u GROUP BY 1, 2)"""


@query(
    "poisson_noise_floor",
    f"""WITH {DAILY_SQL}, {_DRAWS_SQL}
    SELECT CAST(year(d) AS INTEGER) AS year, CAST(sum(p) AS BIGINT) AS drawn,
           {scores_sql(offsets=_OFFSET_SQL)} FROM draws GROUP BY 1""",
)
def poisson_noise_floor(spark, sf_dir):
    df = daily(spark, sf_dir).select("d", F.col("y").cast("double").alias("y"))
    drawn = df.withColumn("p", poisson_sample(F.col("y"), ["d"], 42)).withColumn(
        "year", F.year("d")
    )
    measured = _NO_PLL | {"drawn": lambda y, p: F.sum(p).cast("bigint")}
    out = sc.score(drawn, F.col("y"), F.col("p"), ["year"], measured, BASELINE_OFFSETS)
    return round_columns(out, list(_NO_PLL))


_MASKED_SQL = (
    f"WITH {PANEL_SQL}, pairs AS (SELECT a.entity, a.d, CASE WHEN a.y_mask = 0 AND "
    "coalesce(b.y_mask, 0) = 0 THEN CAST(a.y AS DOUBLE) END AS y, CAST(b.y AS DOUBLE) AS p "
    "FROM panel a LEFT JOIN panel b ON a.entity = b.entity AND a.d = b.d + 7)"
)


@query(
    "masked_metrics",
    f"{_MASKED_SQL} SELECT entity, {scores_sql()} FROM pairs GROUP BY 1",
)
def masked_metrics(spark, sf_dir):
    df = lag_days(with_mask(panel(spark, sf_dir)), ["y", "y_mask"], [7], "d", ["entity"])
    y = sc.unmasked(F.col("y").cast("double"), F.col("y_mask"), F.col("y_mask_d7"))
    out = sc.score(df, y, F.col("y_d7").cast("double"), ["entity"], _NO_PLL)
    return round_columns(out, list(_NO_PLL))


@query(
    "poisson_ll",
    f"WITH {DAILY_SQL} SELECT CAST(year(a.d) AS INTEGER) AS year, count(b.y) AS n, "
    + r("avg(a.y * ln(b.y + 1.0::DOUBLE) - (b.y + 1.0::DOUBLE) - lgamma(a.y + 1.0::DOUBLE)) "
        "FILTER (WHERE b.y IS NOT NULL)")
    + ' AS "PLL" FROM daily a LEFT JOIN daily b ON a.d = b.d + 7 GROUP BY 1',
)
def poisson_ll(spark, sf_dir):
    pairs = lagged_pairs(daily(spark, sf_dir), "y", [7], "d").withColumn("year", F.year("d"))
    out = sc.score(
        pairs, F.col("y"), F.col("p") + 1.0, ["year"], {"PLL": SCORES["PLL"]}
    )
    return round_columns(out, ["PLL"])


_Z_SQL = (
    f"WITH {DAILY_SQL}, z AS (SELECT a.d, CAST(a.y AS DOUBLE) AS y, a.revenue / 1e5 AS rev, "
    "ln(b.y + 1.0::DOUBLE) AS z, ln(b.revenue / 1e5 + 1.0::DOUBLE) AS zr "
    "FROM daily a JOIN daily b ON a.d = b.d + 7)"
)


def _loss_sql(kind: str, y: str, z: str) -> str:
    if kind == "MSE":
        return f"avg((exp({z}) - {y}) * (exp({z}) - {y}))"
    return f"avg(exp({z}) - {z} * {y} + lgamma({y} + 1.0::DOUBLE))"


def _with_logits(spark, sf_dir):
    df = lag_days(daily(spark, sf_dir), ["y", "revenue"], [7], "d")
    return df.select(
        "d",
        F.year("d").alias("year"),
        F.col("y").cast("double").alias("y"),
        (F.col("revenue") / 1e5).alias("rev"),
        F.ln(F.col("y_d7") + 1.0).alias("z"),
        F.ln(F.col("revenue_d7") / 1e5 + 1.0).alias("zr"),
    )


@query(
    "losses_from_logits",
    f"{_Z_SQL} SELECT CAST(year(d) AS INTEGER) AS year, {r(_loss_sql('MSE', 'y', 'z'))} AS \"MSE\", "
    f"{r(_loss_sql('Poisson', 'y', 'z'))} AS \"Poisson\" FROM z GROUP BY 1",
)
def losses_from_logits(spark, sf_dir):
    out = _with_logits(spark, sf_dir).groupBy("year").agg(
        *[loss(F.col("y"), F.col("z")).alias(name) for name, loss in LOSSES.items()]
    )
    return round_columns(out, list(LOSSES))


@query(
    "losses_resampled",
    f"""{_Z_SQL}, {_DRAWS_SQL}
    SELECT CAST(year(z.d) AS INTEGER) AS year, {r(_loss_sql('MSE', 'p', 'z'))} AS "RdMSE",
           {r(_loss_sql('Poisson', 'p', 'z'))} AS "RdPoisson"
    FROM z JOIN draws ON z.d = draws.d GROUP BY 1""",
)
def losses_resampled(spark, sf_dir):
    df = _with_logits(spark, sf_dir)
    out = sc.resampled_losses(df, F.col("y"), F.col("z"), ["d"], ["year"])
    return round_columns(out, ["RdMSE", "RdPoisson"])


@query(
    "weighted_loss",
    f"{_Z_SQL} SELECT CAST(year(d) AS INTEGER) AS year, {r(_loss_sql('Poisson', 'y', 'z'))} "
    f"AS loss_y, {r(_loss_sql('Poisson', 'rev', 'zr'))} AS loss_revenue, "
    + r(f"{_loss_sql('Poisson', 'y', 'z')} + 0.1::DOUBLE * {_loss_sql('Poisson', 'rev', 'zr')}")
    + " AS loss FROM z GROUP BY 1",
)
def weighted_loss(spark, sf_dir):
    out = sc.weighted_loss(
        _with_logits(spark, sf_dir),
        {"y": (F.col("y"), F.col("z")), "revenue": (F.col("rev"), F.col("zr"))},
        "y=1,revenue=0.1", "Poisson", ["year"],
    )
    return round_columns(out, ["loss_y", "loss_revenue", "loss"])


@query(
    "regression_scores",
    f"""WITH unit AS (
      SELECT l_returnflag, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1),
    pairs AS (SELECT year(l_shipdate) AS year, l_extendedprice AS y, l_quantity * price AS p
              FROM lineitem JOIN unit USING (l_returnflag))
    SELECT CAST(year AS INTEGER) AS year, count(*) AS n, {r('avg(abs(y - p))', 4)} AS "MAE",
           {r('-sqrt(avg((y - p) * (y - p)))', 4)} AS "RMSE",
           {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS "R2"
    FROM pairs GROUP BY 1""",
)
def regression_scores(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_quantity", "l_extendedprice", F.year("l_shipdate").alias("year")
    )
    unit = df.groupBy("l_returnflag").agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price")
    )
    out = sc.score(
        df.join(checked_broadcast(unit, "unit"), "l_returnflag"), F.col("l_extendedprice"),
        F.col("l_quantity") * F.col("price"), ["year"], REGRESSION_SCORES,
    )
    return round_columns(round_columns(out, ["MAE", "RMSE"], 4), ["R2"])


# --- parameter sweep ------------------------------------------------------------

GRID = grid({"lag": LAGS, "offset": (0, 1), "blend": (0.0, 0.5)})
_NAMES = {"lag": "l", "offset": "o", "blend": "b"}
_SWEEP_SCORES = {"RMSE": rmse, "PRMS": poisson_rms}


def _sweep(spark, sf_dir):
    df = panel(spark, sf_dir)
    ready = df.select(
        "entity",
        "y",
        running_mean(F.col("y"), "d", ["entity"]).alias("running"),
        *[day_lag(F.col("y"), n, "d", ["entity"]).alias(f"lag{n}") for n in LAGS],
    )

    def predict(run):
        lagged = F.col(f"lag{run['lag']}") + F.lit(run["offset"])
        share = F.lit(run["blend"])
        return (F.lit(1.0) - share) * lagged + share * F.col("running")

    out = sweep_scores(ready, F.col("y"), predict, GRID, ["entity"], _SWEEP_SCORES)
    return out.withColumn("run", run_name_column(_NAMES))


_SWEEP_SQL = (
    f"WITH {PANEL_SQL}, runs(run_id, lag, \"offset\", blend) AS (VALUES "
    + ", ".join(f"({g['run_id']}, {g['lag']}, {g['offset']}, {g['blend']}::DOUBLE)" for g in GRID)
    + """), means AS (SELECT entity, d, y, avg(y) OVER (PARTITION BY entity ORDER BY d
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running FROM panel),
    pairs AS (SELECT a.entity, runs.*, CAST(a.y AS DOUBLE) AS y,
        (1 - blend) * (b.y + "offset") + blend * a.running AS p
        FROM means a CROSS JOIN runs LEFT JOIN panel b ON a.entity = b.entity AND a.d = b.d + lag),
    scored AS (SELECT entity, CAST(run_id AS INTEGER) AS run_id, CAST(lag AS INTEGER) AS lag,
        CAST("offset" AS INTEGER) AS "offset", blend,
        count(p) AS n, """
    + ", ".join(f"{metric_sql()[k]} AS \"{k}\"" for k in _SWEEP_SCORES)
    + ", 'l' || CAST(any_value(lag) AS VARCHAR) || '_o' || CAST(any_value(\"offset\") AS VARCHAR) "
    "|| '_b' || CAST(any_value(blend) AS VARCHAR) AS run FROM pairs GROUP BY 1, 2, 3, 4, 5)"
)
_SWEEP_LIST = 'entity, run_id, lag, "offset", blend, n, run, ' + ", ".join(
    f"{r(chr(34) + k + chr(34))} AS \"{k}\"" for k in _SWEEP_SCORES
)


@query("param_sweep", f"{_SWEEP_SQL} SELECT {_SWEEP_LIST} FROM scored")
def param_sweep(spark, sf_dir):
    return round_columns(_sweep(spark, sf_dir), list(_SWEEP_SCORES))


@query(
    "best_run",
    f"{_SWEEP_SQL} SELECT {_SWEEP_LIST} FROM scored "
    'QUALIFY row_number() OVER (PARTITION BY entity ORDER BY "RMSE", run_id) = 1',
)
def best_run(spark, sf_dir):
    out = pick_best(_sweep(spark, sf_dir), ["entity"], "RMSE", highest=False)
    return round_columns(out, list(_SWEEP_SCORES))
