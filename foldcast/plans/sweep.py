"""A parameter grid scored in one job."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.metrics import SCORES, Metric
from foldcast.operators.scores import score


def grid(values: Mapping[str, Sequence]) -> list[dict]:
    """All combinations in order, numbered from 1."""
    names = list(values)
    return [
        {"run_id": i, **dict(zip(names, combination))}
        for i, combination in enumerate(itertools.product(*values.values()), start=1)
    ]


def sweep_scores(
    df: DataFrame,
    y: Column,
    predict: Callable[[Mapping[str, object]], Column],
    runs: Sequence[Mapping[str, object]],
    by: Sequence[str] = (),
    metrics: Mapping[str, Metric] = SCORES,
) -> DataFrame:
    """Scores per run (and per ``by``). ``predict`` maps the parameters of a run to a
    column. A row becomes one prediction per run within its own task, and the scores
    are combined there before the shuffle."""
    entries = [
        F.struct(
            *[F.lit(v).alias(k) for k, v in run.items()],
            y.cast("double").alias("y"),
            predict(run).cast("double").alias("p"),
        )
        for run in runs
    ]
    parameters = list(runs[0])
    long = df.select(*by, F.inline(F.array(*entries)))
    return score(long, F.col("y"), F.col("p"), [*by, *parameters], metrics)


def best_run(
    scores: DataFrame, by: Sequence[str], metric: str, highest: bool = True
) -> DataFrame:
    """The best run per group; the smaller run number wins a tie."""
    value = F.col(metric) if highest else -F.col(metric)
    best = F.max_by(F.struct(*[c for c in scores.columns if c not in by]),
                    F.struct(value, -F.col("run_id")))
    return scores.where(F.col(metric).isNotNull()).groupBy(*by).agg(best.alias("_b")).select(
        *by, "_b.*"
    )
