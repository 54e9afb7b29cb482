"""Greedy choice of features for a linear model from one pass over the data.

The fit and the score of any subset of features follow from the counts, means and
covariances of all features with each other and with the target. Those are one
distributed aggregate per data set; the search itself solves small systems.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.operators.columns import known_numbers, quoted

_NATIVE_WIDTH = 20


@dataclass(frozen=True)
class Moments:
    """Count, means and centred products of (features, target), target last."""

    n: int
    mean: np.ndarray
    products: np.ndarray


def moments(
    rows: DataFrame, features: Sequence[str], target: str, split: str = "split"
) -> dict[str, Moments]:
    """Moments per split. Rows with a null among the columns are left out."""
    names = [*features, target]
    typed = known_numbers(rows, names).where(quoted(split).isNotNull()).select(
        quoted(split).alias("_split"),
        *[quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)],
    )
    wide = len(names) > _NATIVE_WIDTH
    return _by_batches(typed, len(names)) if wide else _by_expressions(typed, len(names))


def _by_expressions(typed: DataFrame, k: int) -> dict[str, Moments]:
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    table = typed.groupBy("_split").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f"v{i}") for i in range(k)]).alias("mean"),
        F.array(*[F.covar_pop(f"v{i}", f"v{j}") for i, j in pairs]).alias("cov"),
    )
    out = {}
    for row in table.collect():  # a row per split
        products = np.zeros((k, k))
        for (i, j), c in zip(pairs, row["cov"]):
            products[i, j] = products[j, i] = c * row["n"]
        out[row["_split"]] = Moments(row["n"], np.array(row["mean"]), products)
    return out


def _by_batches(typed: DataFrame, k: int) -> dict[str, Moments]:
    """For many columns: products per Arrow batch, summed by Spark."""
    centre_row = typed.agg(*[F.avg(f"v{i}") for i in range(k)]).head()
    centre = [c if c is not None else 0.0 for c in centre_row]

    def products(batches):
        import numpy as np
        import pandas as pd

        shift = np.array(centre)
        sums: dict = {}
        for pdf in batches:
            for split, part in pdf.groupby("_split"):
                x = part[[f"v{i}" for i in range(k)]].to_numpy() - shift
                one = np.column_stack([np.ones(len(x)), x])
                sums[split] = sums.get(split, 0.0) + one.T @ one
        for split, total in sums.items():
            i, j = np.indices(total.shape)
            yield pd.DataFrame(
                {"_split": split, "i": i.ravel(), "j": j.ravel(), "s": total.ravel()}
            )

    summed = (
        typed.mapInPandas(products, "_split string, i int, j int, s double")
        .groupBy("_split", "i", "j").agg(F.sum("s").alias("s"))
    )
    full: dict[str, np.ndarray] = {}
    for row in summed.collect():  # (k + 1)^2 numbers per split
        full.setdefault(row["_split"], np.zeros((k + 1, k + 1)))[row.i, row.j] = row.s
    out = {}
    for split, g in full.items():
        n = g[0, 0]
        shifted = g[0, 1:] / n
        out[split] = Moments(
            int(round(n)), np.array(centre) + shifted, g[1:, 1:] - n * np.outer(shifted, shifted)
        )
    return out


def subset_r2(train: Moments, valid: Moments, chosen: Sequence[int]) -> float:
    """R2 on the valid rows of the least squares fit on the train rows."""
    y = len(train.mean) - 1
    idx = list(chosen)
    gxx, gxy = train.products[np.ix_(idx, idx)], train.products[idx, y]
    w = np.linalg.lstsq(gxx, gxy, rcond=None)[0] if idx else np.zeros(0)
    intercept = train.mean[y] - w @ train.mean[idx]
    vxx, vxy = valid.products[np.ix_(idx, idx)], valid.products[idx, y]
    total = valid.products[y, y]
    offset = valid.mean[y] - intercept - w @ valid.mean[idx]
    residual = total - 2.0 * (w @ vxy) + w @ vxx @ w + valid.n * offset * offset
    return float(1.0 - residual / total) if total > 0 else float("nan")


def _search(
    rows: DataFrame, features: Sequence[str], target: str, split: str, forward: bool
) -> DataFrame:
    found = moments(rows, features, target, split)
    train, valid = found["train"], found["valid"]
    current = [] if forward else list(range(len(features)))
    pending = list(range(len(features)))
    steps = []
    while pending:
        def with_change(i, current=current):
            return sorted([*current, i]) if forward else [c for c in current if c != i]

        scores = {i: subset_r2(train, valid, with_change(i)) for i in pending}
        best = min(pending, key=lambda i: (-scores[i], features[i]))
        current = with_change(best)
        pending.remove(best)
        steps.append((len(steps) + 1, features[best], scores[best]))
    return rows.sparkSession.createDataFrame(steps, "step int, feature string, score double")


def forward_selection(
    rows: DataFrame, features: Sequence[str], target: str, split: str = "split"
) -> DataFrame:
    """Add, step by step, the feature that raises the valid R2 most."""
    return _search(rows, features, target, split, forward=True)


def backward_elimination(
    rows: DataFrame, features: Sequence[str], target: str, split: str = "split"
) -> DataFrame:
    """Remove, step by step, the feature whose loss leaves the highest valid R2."""
    return _search(rows, features, target, split, forward=False)
