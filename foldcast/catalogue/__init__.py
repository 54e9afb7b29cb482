"""Registered queries over the given tables, each with its oracle where SQL can say it."""

from foldcast.catalogue.common import ORACLES, QUERIES
from foldcast.catalogue import (  # noqa: F401  (import registers the queries)
    baselines,
    folds,
    models,
    series,
    streams,
    tables,
)

__all__ = ["ORACLES", "QUERIES"]
