"""The jobs a user runs: prepare a data set, fit it, score stored models, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.functions.metrics import REGRESSION_SCORES, SCORES, Metric
from foldcast.functions.text import names_in_groups, run_name
from foldcast.operators.columns import require
from foldcast.operators.folds import shuffled_copies
from foldcast.operators.scores import fold_summary, mean_importance
from foldcast.plans.metadata import ColumnTable
from foldcast.plans.models import (
    apply_stored, fit_folds, fold_scores, importances, predict_stored, prediction_rows, score_table,
)
from foldcast.plans.preparation import Prepared, prepare_folds
from foldcast.sources.layout import RunLayout


def prepare_dataset(
    df: DataFrame,
    table: ColumnTable,
    layout: RunLayout,
    dataset: str,
    train_years: Sequence[int],
    valid_years: int = 1,
    lags: Sequence[int] = (),
    keys: Sequence[str] = (),
    null_scope: str = "split",
    learn_from: DataFrame | None = None,
) -> Prepared:
    """Prepare all folds and store rows, learnt statistics and the column table."""
    prepared = prepare_folds(
        df, table, train_years, valid_years, lags, keys, null_scope, learn_from=learn_from
    )
    layout.write_folds(prepared.rows, dataset, lags, prepared.table.sort_columns(), valid_years)
    layout.write_statistics(prepared.statistics, dataset, lags, valid_years)
    path = layout.columns(dataset, lags, valid_years)
    prepared.table.write(df.sparkSession, path, mode="overwrite")
    return prepared


def chosen_features(
    table: ColumnTable, explicit: Sequence[str] | None, groups: Sequence[str] | None
) -> list[str]:
    """Explicit names and groups; all features if neither is given."""
    every = table.features()
    if explicit is None and groups is None:
        return every
    return names_in_groups(every, groups or (), explicit or ())


def fit_dataset(
    spark: SparkSession,
    layout: RunLayout,
    dataset: str,
    model: str,
    folds: Sequence[int],
    lags: Sequence[int] = (),
    targets: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    groups: Sequence[str] | None = None,
    fakes: bool = False,
    row_keys: Sequence[str] = (),
    metrics: Mapping[str, Metric] = REGRESSION_SCORES,
    valid_years: int = 1,
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """Fit per target and fold, store models and scores; returns the score rows and
    the mean importance of the features.

    ``fakes`` adds a shuffled copy of every feature, within each fold and split;
    ``row_keys`` then name the columns that identify a row there.
    """
    table = ColumnTable.read(spark, layout.columns(dataset, lags, valid_years))
    rows = layout.read_folds(spark, dataset, lags, valid_years=valid_years)
    rows = rows.where(F.col("fold").isin(list(folds)))
    names = chosen_features(table, features, groups)
    require(rows, names)
    if fakes:
        rows = shuffled_copies(
            rows, names, row_keys or [table.date_column()], within=["fold", "split"]
        )
        names = [*names, *[f"{n}_fake" for n in names]]
    label = _chosen(features, groups)
    scores, weights = None, None
    for target in targets or table.targets():
        predicted, models = fit_folds(rows, names, target, model, folds, **settings)
        run = _run(model, target, label, lags, valid_years, settings, fakes)
        for fold, fitted in models.items():
            fitted.write().overwrite().save(layout.model(dataset, fold, run))
        found = score_table(
            fold_scores(predicted, target, metrics), dataset, target, model, label, list(metrics)
        ).withColumn("run", F.lit(run))
        shares = importances(models, names, rows)
        scores = found if scores is None else scores.unionByName(found)
        weights = shares if weights is None else weights.unionByName(shares)
    layout.write_scores(scores)
    return scores, mean_importance(weights)


def _chosen(features: Sequence[str] | None, groups: Sequence[str] | None) -> list[str]:
    return ["all"] if groups is None and features is None else [*(groups or []), *(features or [])]


def _run(
    model: str, target: str, label: Sequence[str], lags: Sequence[int], valid_years: int,
    settings: Mapping[str, object], fakes: bool = False,
) -> str:
    """All that tells one run on a data set from another."""
    named = {
        "model": model, "target": target, "features": list(label), "fakes": fakes,
        "lags": list(lags) or None, "valid": valid_years,
    }
    short = {"model": "", "target": "", "features": "", "fakes": "fakes", "lags": "lags", "valid": "valid"}
    return run_name(short | {k: k for k in settings}, **named, **settings)


def evaluate_dataset(
    spark: SparkSession,
    layout: RunLayout,
    dataset: str,
    model: str,
    folds: Sequence[int],
    lags: Sequence[int] = (),
    targets: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    groups: Sequence[str] | None = None,
    metrics: Mapping[str, Metric] = SCORES,
    valid_years: int = 1,
    **settings,
) -> DataFrame:
    """Load the stored model of each fold, apply it to train and valid rows and
    summarise the scores over the folds, with mean and sample std."""
    table = ColumnTable.read(spark, layout.columns(dataset, lags, valid_years))
    names = chosen_features(table, features, groups)
    every = None
    for target in targets or table.targets():
        run = _run(model, target, _chosen(features, groups), lags, valid_years, settings)
        for fold in folds:
            path = layout.model(dataset, fold, run)
            rows = layout.read_folds(spark, dataset, lags, fold, valid_years=valid_years)
            found = score_table(
                fold_scores(apply_stored(path, rows, names, target), target, metrics),
                dataset, target, model, names, list(metrics),
            )
            every = found if every is None else every.unionByName(found)
    return fold_summary(every, ["target", "model", "split", "metric"], "fold", folds)


def predict_dataset(
    spark: SparkSession,
    layout: RunLayout,
    dataset: str,
    model: str,
    folds: Sequence[int],
    lags: Sequence[int] = (),
    targets: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    groups: Sequence[str] | None = None,
    valid_years: int = 1,
    **settings,
) -> DataFrame:
    """Apply the stored model of each fold to its train and valid rows and store the result:
    (dataset, run, fold, split, target, series, date, value), where ``series`` is ``actual`` or the
    model. Rows whose target is not known are predicted too; rows without all features are not."""
    table = ColumnTable.read(spark, layout.columns(dataset, lags, valid_years))
    names = chosen_features(table, features, groups)
    every, runs = None, []
    for target in targets or table.targets():
        run = _run(model, target, _chosen(features, groups), lags, valid_years, settings)
        runs.append(run)
        for fold in folds:
            rows = layout.read_folds(spark, dataset, lags, fold, valid_years=valid_years)
            found = prediction_rows(
                predict_stored(layout.model(dataset, fold, run), rows, names),
                target, model, table.date_column(),
            ).withColumns({"dataset": F.lit(dataset), "run": F.lit(run)})
            every = found if every is None else every.unionByName(found)
    layout.write_predictions(every)
    stored = spark.read.parquet(layout.predictions)
    return stored.where(
        (F.col("dataset").cast("string") == dataset) & F.col("run").isin(runs)
        & F.col("fold").isin(list(folds))
    )


def score_report(
    spark: SparkSession, layout: RunLayout, dataset: str, folds: Sequence[int] | None = None
) -> DataFrame:
    """Stored scores of a data set by run, folds as columns, with mean and sample std."""
    stored = spark.read.parquet(layout.scores).where(F.col("dataset").cast("string") == dataset)
    return fold_summary(stored, ["run", "target", "model", "features", "split", "metric"], "fold", folds)
