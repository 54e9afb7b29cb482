"""Naive forecasts and their scores, all models and years in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.metrics import BASELINE_OFFSETS, CARRIED_OFFSETS
from foldcast.functions.sampling import poisson_sample
from foldcast.operators.columns import quoted
from foldcast.operators.scores import score, unmasked
from foldcast.operators.series import day_lag, running_mean

LAGS = (1, 7, 364, 365)  # fixed value


def baseline_predictions(
    series: DataFrame,
    target: str,
    day: str,
    keys: Sequence[str] = (),
    mask: str | None = None,
    lags: Sequence[int] = LAGS,
    noise_seed: int | None = None,
    mask_needs_both: bool = False,
) -> DataFrame:
    """Long table (keys, day, model, y, p): running mean, calendar lags, and the
    noise floor, a Poisson draw around the actual value, if a seed is given.

    The lags and the mean share one shuffle by key. A row that must not count has
    a null ``y``. ``mask_needs_both`` drops a lag row only where both the value
    and the lagged value are masked.
    """
    y = quoted(target).cast("double")
    hidden = quoted(mask) if mask else F.lit(0)
    wide = series.select(
        *keys,
        day,
        y.alias("_y"),
        hidden.alias("_mask"),
        running_mean(y, day, keys, hidden).alias("_mean"),
        *[day_lag(y, n, day, keys).alias(f"_lag{n}") for n in lags],
        *[day_lag(hidden, n, day, keys).alias(f"_hid{n}") for n in lags],
    )
    own = unmasked(F.col("_y"), F.col("_mask"))

    def entry(name: str, value: Column, prediction: Column) -> Column:
        return F.struct(F.lit(name).alias("model"), value.alias("y"), prediction.alias("p"))

    entries = [entry("mean", own, F.col("_mean"))]
    if noise_seed is not None:
        wide = wide.withColumn(
            "_noise", poisson_sample(F.col("_y"), [*keys, day], noise_seed)
        )
        entries.append(entry("noise", own, F.col("_noise")))
    for n in lags:
        value = unmasked(F.col("_y"), F.col("_mask"), F.col(f"_hid{n}"), every=mask_needs_both)
        entries.append(entry(f"lag {n}", value, F.col(f"_lag{n}")))
    return wide.select(*keys, day, F.inline(F.array(*entries)))


def baseline_scores(
    predictions: DataFrame,
    day: str,
    by: Sequence[str] = (),
    first_year: int | None = None,
    last_year: int | None = None,
    carried_offsets: bool = False,
) -> DataFrame:
    """Scores per model and test year (and per ``by``). Two scores are taken at
    prediction + 1, since a count baseline may predict 0."""
    rows = predictions.withColumn("year", F.year(quoted(day)))
    if first_year is not None:
        rows = rows.where(F.col("year") >= first_year)
    if last_year is not None:
        rows = rows.where(F.col("year") <= last_year)
    offsets = CARRIED_OFFSETS if carried_offsets else BASELINE_OFFSETS
    return score(rows, F.col("y"), F.col("p"), [*by, "model", "year"], offsets=offsets)


def mean_model(
    by_year: DataFrame, folds: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Per key and fold the log of the mean target over the training years, which is
    the intercept of a log-link model without features.

    ``by_year`` holds (keys, year, n, total): yearly sums, so that the folds
    multiply these few rows and not the data.
    """
    train = folds.where(F.col("split") == "train").select("fold", "year")
    return (
        by_year.join(F.broadcast(train), "year")
        .groupBy(*keys, "fold")
        .agg(F.ln(F.nullif(F.sum("total") / F.sum("n"), F.lit(0.0))).alias("intercept"))
    )
