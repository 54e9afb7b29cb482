"""Score tables: masked scores by group, long form, fold summaries."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.metrics import LOSSES, SCORES, Metric, score_columns
from foldcast.functions.sampling import poisson_sample
from foldcast.functions.text import weight_map
from foldcast.operators.columns import quoted

log = logging.getLogger(__name__)


def unmasked(value: Column, *masks: Column, every: bool = False) -> Column:
    """The value where no mask is set. ``every=True`` drops it only where all masks
    are set, which lets through rows whose prediction is masked."""
    hidden = None
    for mask in masks:
        is_set = F.coalesce(mask != 0, F.lit(False))
        if hidden is None:
            hidden = is_set
        else:
            hidden = hidden & is_set if every else hidden | is_set
    return value if hidden is None else F.when(~hidden, value)


def score(
    df: DataFrame,
    y: Column,
    p: Column,
    by: Sequence[str] = (),
    metrics: Mapping[str, Metric] = SCORES,
    offsets: Mapping[str, float] | None = None,
) -> DataFrame:
    """All metrics per group in one aggregate, with the number of rows counted."""
    counted = F.count(F.when(p.isNotNull(), y)).cast("bigint").alias("n")
    return df.groupBy(*by).agg(counted, *score_columns(y, p, metrics, offsets))


def long_scores(
    scores: DataFrame, metrics: Sequence[str] = tuple(SCORES)
) -> DataFrame:
    """One row per group and metric: the form in which scores are stored."""
    by = [c for c in scores.columns if c not in metrics]
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), quoted(m).alias("value")) for m in metrics]
    )
    return scores.select(*by, F.inline(pairs))


def fold_summary(
    scores: DataFrame,
    by: Sequence[str] = ("model", "metric"),
    fold: str = "fold",
    folds: Sequence | None = None,
) -> DataFrame:
    """Folds as columns, with mean and sample std over the folds, in one aggregate."""
    if folds is None:
        folds = sorted(r[0] for r in scores.select(fold).distinct().collect())
    return scores.groupBy(*by).agg(
        *[F.max(F.when(F.col(fold) == f, F.col("value"))).alias(str(f)) for f in folds],
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )


def weighted_loss(
    df: DataFrame,
    targets: Mapping[str, tuple[Column, Column]],
    weights: str | None,
    loss: str | Metric = "Poisson",
    by: Sequence[str] = (),
) -> DataFrame:
    """Sum over the targets of weight times loss, with each target's loss beside it.

    ``targets`` maps a name to (value, prediction on the log scale); ``weights`` is
    text such as ``a=1,b=0.5``. A target without a weight counts once.
    """
    measure = LOSSES[loss] if isinstance(loss, str) else loss
    known = weight_map(F.lit(weights or ""))
    if weights:
        named = [part.split("=")[0].strip() for part in weights.split(",")]
        extra = [n for n in named if n not in targets]
        if extra:
            log.warning("weights for unknown targets: %s", extra)
        absent = [t for t in targets if t not in named]
        if absent:
            log.warning("targets without a weight count once: %s", absent)
    losses = df.groupBy(*by).agg(
        *[measure(y, z).alias(f"loss_{name}") for name, (y, z) in targets.items()]
    )
    total = F.lit(0.0)
    for name in targets:
        weight = F.coalesce(F.try_element_at(known, F.lit(name)), F.lit(1.0))
        total = total + weight * F.col(f"loss_{name}")
    return losses.withColumn("loss", total)


def resampled_losses(
    df: DataFrame,
    y: Column,
    z: Column,
    keys: Sequence[str],
    by: Sequence[str] = (),
    losses: Mapping[str, Metric] = LOSSES,
    seed: int = 42,
) -> DataFrame:
    """Each loss against a Poisson draw around the actual value in place of the value
    itself, named with ``Rd`` before it. The draw is fixed by the row's key."""
    drawn = df.withColumn("_drawn", poisson_sample(y, keys, seed))
    return drawn.groupBy(*by).agg(
        *[loss(F.col("_drawn"), z).alias(f"Rd{name}") for name, loss in losses.items()]
    )


def mean_importance(
    importances: DataFrame, threshold: float = 1e-3
) -> DataFrame:
    """(feature, importance) rows of all folds averaged; those above the threshold
    are marked, most important first."""
    return (
        importances.groupBy("feature")
        .agg(F.avg("importance").alias("importance"))
        .withColumn("selected", F.col("importance") > threshold)
        .orderBy(F.desc("importance"), "feature")
    )
