"""Linear models with a penalty, solved from the moments of their columns.

One distributed aggregate gives the means and products of all columns; the coefficients follow from these by
block coordinate descent on the driver, whose work depends on the number of columns only. A
fitted model is one SQL expression, so it predicts inside Spark and is stored as any other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.operators.columns import known_numbers, quoted
from foldcast.plans.subset_search import moments

PREDICTION = "p"


def block_descent(
    gram: np.ndarray, cross: np.ndarray, penalty: np.ndarray, tolerance: float = 1e-13, sweeps: int = 100_000
) -> np.ndarray:
    """The W (columns x targets) that minimises 1/2 tr(W' gram W) - tr(W' cross) + sum_j penalty_j |W_j|,
    |W_j| being the length of row j over all targets. Columns without a penalty are solved for exactly and
    taken out first; of columns that others determine, those get coefficients that keep them smallest."""
    free = penalty <= 0
    inverse = np.linalg.pinv(gram[np.ix_(free, free)], rcond=1e-12, hermitian=True)
    toward = inverse @ gram[np.ix_(free, ~free)]
    g = gram[np.ix_(~free, ~free)] - gram[np.ix_(~free, free)] @ toward
    c = cross[~free] - toward.T @ cross[free]
    alpha, own = penalty[~free], np.diag(g).copy()
    usable = own > 1e-12 * np.maximum(np.diag(gram)[~free], 1e-300)
    w = np.zeros_like(c)
    rest = c.copy()  # c - g @ w
    scale = np.sqrt(np.maximum(own, 0.0))
    for _ in range(sweeps):
        largest = 0.0
        for j in np.flatnonzero(usable):
            pull = rest[j] + own[j] * w[j]
            length = float(np.linalg.norm(pull))
            new = pull * (max(0.0, 1.0 - alpha[j] / length) / own[j]) if length > 0 else np.zeros_like(pull)
            change = new - w[j]
            if change.any():
                rest -= np.outer(g[:, j], change)
                w[j] = new
                largest = max(largest, scale[j] * float(np.abs(change).max()))
        if largest <= tolerance * (1.0 + float(np.abs(scale[:, None] * w).max(initial=0.0))):
            break
    out = np.zeros_like(cross)
    out[~free] = w
    out[free] = inverse @ (cross[free] - gram[np.ix_(free, ~free)] @ w)
    return out


def _literal(value: float) -> str:
    return f"{float(value)!r}D" if math.isfinite(value) else "CAST('NaN' AS DOUBLE)"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


class MomentEstimator(Estimator):
    """Least squares on SQL expressions with a penalty for each.

    ``terms`` maps names to expressions over the rows; ``penalty`` those that have one. Several ``targets``
    are fitted together, each row of coefficients under one penalty; the model predicts ``label``.
    """

    def __init__(self, label: str, targets: Sequence[str], features: Sequence[str]):
        super().__init__()
        self._label, self._targets, self._features = label, list(targets), list(features)

    def terms(self, rows: DataFrame) -> tuple[dict[str, str], dict[str, float]]:
        raise NotImplementedError

    def coefficients(self, rows: DataFrame) -> tuple[dict[str, str], np.ndarray, np.ndarray]:
        """The terms, their coefficients (terms x targets) and the intercepts."""
        terms, penalty = self.terms(rows)
        columns = [F.expr(sql).cast("double").alias(f"t{i}") for i, sql in enumerate(terms.values())]
        targets = [quoted(t).cast("double").alias(f"y{i}") for i, t in enumerate(self._targets)]
        names = [f"t{i}" for i in range(len(columns))] + [f"y{i}" for i in range(len(targets))]
        table = rows.select(*columns, *targets, F.lit("train").alias("part"))
        found = moments(table, names[:-1], names[-1], "part").get("train")
        if found is None:
            raise ValueError("there are no rows on which all terms and targets are numbers")
        k = len(terms)
        scaled = found.products / found.n
        weights = np.array([float(penalty.get(name, 0.0)) for name in terms])
        w = block_descent(scaled[:k, :k], scaled[:k, k:], weights)
        return terms, w, found.mean[k:] - found.mean[:k] @ w

    def _fit(self, rows: DataFrame) -> SQLTransformer:
        terms, w, intercepts = self.coefficients(rows)
        at = self._targets.index(self._label)
        parts = [_literal(intercepts[at]), *[f"{_literal(b)} * ({sql})" for b, sql in zip(w[:, at], terms.values()) if b]]
        model = SQLTransformer(statement=f"SELECT *, {' + '.join(parts)} AS {PREDICTION} FROM __THIS__")
        by_name = dict(zip(terms, w[:, at].tolist()))
        model.coefficients = [by_name.get(f, 0.0) for f in self._features]
        return model


class JointLasso(MomentEstimator):
    """1/(2n) |Y - XW|^2 + alpha sum_j |W_j|, over all targets ``jointly``: a feature is used for
    all of them or for none. With one target this is the plain lasso."""

    def __init__(self, label: str, features: Sequence[str], alpha: float = 1.0, jointly: Sequence[str] = ()):
        targets = list(dict.fromkeys([*jointly, label]))
        super().__init__(label, targets, features)
        self._alpha = alpha

    def terms(self, rows: DataFrame) -> tuple[dict[str, str], dict[str, float]]:
        terms = {f: f"CAST({_name(f)} AS DOUBLE)" for f in self._features}
        return terms, dict.fromkeys(terms, self._alpha)


def seasonal_sql(
    day: str, weekly: int = 3, yearly: int = 10, origin: str = "1995-01-01", changepoints: Sequence[str] = ()
) -> dict[str, str]:
    """SQL for a trend in years that may bend at each of ``changepoints`` (dates), and for the sine and cosine
    terms of the week and the year."""
    number = f"CAST(datediff(CAST({_name(day)} AS DATE), DATE'{origin}') AS DOUBLE)"
    terms = {"trend": f"{number} / 365.25D"}
    for k, date in enumerate(changepoints):
        past = f"CAST(datediff(CAST({_name(day)} AS DATE), DATE'{date}') AS DOUBLE)"
        terms[f"bend{k + 1}"] = f"greatest({past}, 0D) / 365.25D"
    for name, period, order in (("week", 7.0, weekly), ("year", 365.25, yearly)):
        for k in range(1, order + 1):
            for function in ("sin", "cos"):
                terms[f"{name}_{function}{k}"] = f"{function}({number} * {_literal(2.0 * math.pi * k / period)})"
    return terms


class SeasonalTrend(MomentEstimator):
    """A piecewise linear trend, weekly and yearly terms, and the features as regressors.

    ``changepoints`` are dates, or the number of candidates spread evenly over the first ``spread`` of the
    training days. ``penalty`` is that of each change of slope: with many candidates it leaves the few
    that are needed; zero fits all of them. Trend, seasons and regressors have none.
    """

    def __init__(
        self, label: str, features: Sequence[str] = (), day: str = "d", changepoints: int | Sequence[str] = 25,
        penalty: float = 0.05, spread: float = 0.8, weekly: int = 3, yearly: int = 10, origin: str = "1995-01-01",
    ):
        super().__init__(label, [label], features)
        self._day, self._changepoints, self._penalty, self._spread = day, changepoints, penalty, spread
        self._seasons: Mapping = {"weekly": weekly, "yearly": yearly, "origin": origin}

    def _dates(self, rows: DataFrame) -> list[str]:
        if not isinstance(self._changepoints, int):
            return [str(d) for d in self._changepoints]
        day = quoted(self._day).cast("date")
        usable = known_numbers(rows, [*self._targets, *self._features])
        first, days = usable.agg(F.min(day), F.datediff(F.max(day), F.min(day))).head()
        if first is None or not self._changepoints:
            return []
        step = self._spread * days / self._changepoints
        offsets = sorted({int(round(step * (k + 1))) for k in range(self._changepoints)} - {0})
        return [str(np.datetime64(first) + np.timedelta64(n, "D")) for n in offsets]

    def terms(self, rows: DataFrame) -> tuple[dict[str, str], dict[str, float]]:
        terms = seasonal_sql(self._day, changepoints=self._dates(rows), **self._seasons)
        penalty = {name: self._penalty for name in terms if name.startswith("bend")}
        clash = set(terms) & set(self._features)
        if clash:
            raise ValueError(f"features have names of seasonal terms: {sorted(clash)}")
        return terms | {f: f"CAST({_name(f)} AS DOUBLE)" for f in self._features}, penalty
