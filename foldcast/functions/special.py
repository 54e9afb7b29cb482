"""Log-gamma as a plain expression, so that it stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 7


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, by Stirling's series at x + 7.

    Gamma(x) = Gamma(x + 7) / (x (x + 1) ... (x + 6)); at arguments above 7 the
    series with four correction terms is accurate to about 1e-12.
    """
    z = x + F.lit(float(_SHIFT))
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    series = inv * (
        F.lit(1.0 / 12.0)
        - inv2 * (F.lit(1.0 / 360.0) - inv2 * (F.lit(1.0 / 1260.0) - inv2 * F.lit(1.0 / 1680.0)))
    )
    stirling = (
        (z - F.lit(0.5)) * F.ln(z) - z + F.lit(0.5 * math.log(2.0 * math.pi)) + series
    )
    product = x
    for step in range(1, _SHIFT):
        product = product * (x + F.lit(float(step)))
    return stirling - F.ln(product)
