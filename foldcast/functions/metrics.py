"""Forecast scores and losses, each a ``(y, p) -> Column`` aggregate.

``y`` and ``p`` may be null on rows that must not count: every aggregate skips
a row where either is null. Register another score by adding to the dicts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldcast.functions.special import lgamma

Metric = Callable[[Column, Column], Column]

R2_EPSILON = 1e-7  # fixed value


def _one() -> Column:
    return F.lit(1.0)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def neg_rmse(y: Column, p: Column) -> Column:
    """Negated, so that higher is better when models are selected."""
    return -rmse(y, p)


def poisson_rms(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p) / (y + _one())))


def regularised_mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs((y - p) / (y + _one())))


def patched_mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs((y - p) / F.greatest(y, _one())))


def _paired(y: Column, p: Column) -> Column:
    return F.when(p.isNotNull(), y)


def _total_squares(y: Column, p: Column) -> Column:
    paired = _paired(y, p)
    return F.var_pop(paired) * F.count(paired)


def r2(y: Column, p: Column) -> Column:
    """Centred form of the total sum of squares, plus a small constant."""
    return _one() - F.sum((y - p) * (y - p)) / (_total_squares(y, p) + F.lit(R2_EPSILON))


def r2_exact(y: Column, p: Column) -> Column:
    """Without the constant; null where the target does not vary."""
    total = _total_squares(y, p)
    return _one() - F.sum((y - p) * (y - p)) / F.nullif(total, F.lit(0.0))


def _positive_only(value: Column, y: Column, p: Column) -> Column:
    # ln of a number <= 0 is null in Spark, and avg would skip that row silently.
    return F.when(F.min(F.when(y.isNotNull(), p)) > 0, value)


def poisson_log_likelihood(y: Column, p: Column) -> Column:
    """Null for a group in which any prediction is not positive."""
    return _positive_only(F.avg(y * F.ln(p) - p - lgamma(y + _one())), y, p)


def mse_from_log(y: Column, z: Column) -> Column:
    return F.avg((F.exp(z) - y) * (F.exp(z) - y))


def poisson_loss_from_log(y: Column, z: Column) -> Column:
    return F.avg(F.exp(z) - z * y + lgamma(y + _one()))


# The score and loss names that reports use.
SCORES: dict[str, Metric] = {
    "RMSE": rmse,
    "PRMS": poisson_rms,
    "RdMAPE": regularised_mape,
    "PdMAPE": patched_mape,
    "R2": r2,
    "PLL": poisson_log_likelihood,
}

REGRESSION_SCORES: dict[str, Metric] = {"MAE": mae, "RMSE": neg_rmse, "R2": r2_exact}

LOSSES: dict[str, Metric] = {"MSE": mse_from_log, "Poisson": poisson_loss_from_log}

# Baselines predict counts and may predict 0: these two scores are taken at p + 1.
BASELINE_OFFSETS: dict[str, float] = {"PRMS": 1.0, "PLL": 1.0}
# The offsets that arise when the increments are carried from score to score.
CARRIED_OFFSETS: dict[str, float] = {
    "PRMS": 1.0, "RdMAPE": 1.0, "PdMAPE": 1.0, "R2": 1.0, "PLL": 2.0,
}


def score_columns(
    y: Column,
    p: Column,
    metrics: Mapping[str, Metric] = SCORES,
    offsets: Mapping[str, float] | None = None,
) -> list[Column]:
    """One aggregate per metric, named after it, all computed in one pass."""
    offsets = offsets or {}
    return [
        metric(y, p + F.lit(offsets[name]) if offsets.get(name) else p).alias(name)
        for name, metric in metrics.items()
    ]
