"""MLlib models fitted and scored per fold."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.metrics import REGRESSION_SCORES, Metric
from foldcast.operators.columns import known_numbers, quoted
from foldcast.operators.scores import long_scores, score
from foldcast.plans.penalised import JointLasso, SeasonalTrend

FEATURES = "_features"
PREDICTION = "p"


def _linear(label: str, **settings):
    return LinearRegression(
        featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION,
        regParam=0.0, solver="normal", **settings,
    )


def _lasso(label: str, alpha: float = 1.0, max_iter: int = 1000):
    return LinearRegression(
        featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION,
        regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=max_iter,
    )


def _tree(label: str, max_depth: int = 6, min_impurity_decrease: float = 0.0, seed: int = 42):
    return DecisionTreeRegressor(
        featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION,
        maxDepth=max_depth, minInfoGain=min_impurity_decrease, seed=seed,
    )


def _boosted(
    label: str, eta: float = 0.3, subsample: float = 1.0, max_depth: int = 6,
    rounds: int = 20, seed: int = 42,
):
    return GBTRegressor(
        featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION, stepSize=eta,
        subsamplingRate=subsample, maxDepth=max_depth, maxIter=rounds, seed=seed,
    )


def _glm(label: str, family: str = "poisson", l2: float = 0.0, max_iter: int = 50):
    return GeneralizedLinearRegression(
        featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION,
        family=family, link="log", regParam=l2, maxIter=max_iter,
    )


# Register another model by adding a factory (label column, settings) -> estimator.
ESTIMATORS: dict[str, Callable] = {
    "linear": _linear,
    "lasso": _lasso,
    "tree": _tree,
    "boosted": _boosted,
    "count": _glm,
}
# Models that name their columns themselves: (label column, features, settings) -> estimator.
NAMED_ESTIMATORS: dict[str, Callable] = {"joint_lasso": JointLasso, "seasonal": SeasonalTrend}


def model_steps(model: str, features: Sequence[str], target: str, **settings) -> Pipeline:
    if model in NAMED_ESTIMATORS:
        return Pipeline(stages=[NAMED_ESTIMATORS[model](target, list(features), **settings)])
    if model not in ESTIMATORS:
        raise ValueError(f"unknown model {model}; known: {sorted({*ESTIMATORS, *NAMED_ESTIMATORS})}")
    assemble = VectorAssembler(inputCols=list(features), outputCol=FEATURES)
    return Pipeline(stages=[assemble, ESTIMATORS[model](target, **settings)])


def usable_rows(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows with all features and the target; a model cannot use others."""
    names = [*features, target]
    return known_numbers(rows, names).withColumns({c: quoted(c).cast("double") for c in names})


def fit_folds(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    model: str,
    folds: Sequence[int],
    **settings,
) -> tuple[DataFrame, dict[int, PipelineModel]]:
    """One fitted model per fold, and the predictions on train and valid rows of all
    folds. The loop runs over folds; each fit is a distributed job.

    ``rows`` carry ``fold`` and ``split``; pass them persisted or read from a table.
    """
    usable = usable_rows(rows, features, target)
    models, predicted = {}, None
    for fold in folds:
        of_fold = usable.where(F.col("fold") == fold)
        fitted = model_steps(model, features, target, **settings).fit(
            of_fold.where("split = 'train'")
        )
        models[fold] = fitted
        scored = fitted.transform(of_fold).drop(FEATURES)
        predicted = scored if predicted is None else predicted.unionByName(scored)
    if predicted is None:
        raise ValueError("no folds given")
    return predicted, models


def fold_scores(
    predicted: DataFrame,
    target: str,
    metrics: Mapping[str, Metric] = REGRESSION_SCORES,
    by: Sequence[str] = ("fold", "split"),
) -> DataFrame:
    return score(predicted, quoted(target), F.col(PREDICTION), by, metrics)


def score_table(
    scores: DataFrame, dataset: str, target: str, model: str, features: Sequence[str],
    metrics: Sequence[str] = tuple(REGRESSION_SCORES),
) -> DataFrame:
    """Scores in the stored form: a labelled row per fold, split and metric."""
    labels = {"dataset": dataset, "target": target, "model": model, "features": "_".join(features)}
    long = long_scores(scores.drop("n"), metrics)
    return long.withColumns({name: F.lit(value) for name, value in labels.items()})


def apply_stored(path: str, rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Predictions of a stored model."""
    return PipelineModel.load(path).transform(usable_rows(rows, features, target)).drop(FEATURES)


def predict_stored(path: str, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Predictions of a stored model for all rows with all features, their target known or not."""
    usable = known_numbers(rows, features).withColumns({c: quoted(c).cast("double") for c in features})
    return PipelineModel.load(path).transform(usable).drop(FEATURES)


def prediction_rows(predicted: DataFrame, target: str, series: str, day: str) -> DataFrame:
    """(fold, split, target, series, date, value): each row's actual value and its prediction."""
    pairs = F.array(
        F.struct(F.lit("actual").alias("series"), quoted(target).cast("double").alias("value")),
        F.struct(F.lit(series).alias("series"), F.col(PREDICTION).alias("value")),
    )
    return predicted.select(
        "fold", "split", F.lit(target).alias("target"), quoted(day).alias("date"), F.inline(pairs)
    )


def importances(
    models: Mapping[int, PipelineModel], features: Sequence[str], rows: DataFrame
) -> DataFrame:
    """(fold, feature, importance): tree importances, or coefficients of a linear
    model. A row per fold and feature."""
    out = []
    for fold, fitted in models.items():
        last = fitted.stages[-1]
        values = (
            last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        )
        out += [(fold, f, float(values[i])) for i, f in enumerate(features)]
    return rows.sparkSession.createDataFrame(
        out, "fold int, feature string, importance double"
    )


def seasonal_terms(
    day: Column, weekly: int = 3, yearly: int = 10, origin: str = "1995-01-01"
) -> dict[str, Column]:
    """A linear trend in years, and sine and cosine terms of the week and the year."""
    number = F.datediff(day, F.lit(origin).cast("date")).cast("double")
    terms = {"trend": number / F.lit(365.25)}
    for name, period, order in (("week", 7.0, weekly), ("year", 365.25, yearly)):
        for k in range(1, order + 1):
            angle = number * F.lit(2.0 * math.pi * k / period)
            terms[f"{name}_sin{k}"] = F.sin(angle)
            terms[f"{name}_cos{k}"] = F.cos(angle)
    return terms
