"""Random values that depend on a row's key and a seed, not on its partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits: every value is exact as a double
_SUM_FROM_ZERO = 500.0


def key_hash(keys: Sequence[Column | str], seed: int | str) -> Column:
    """A 52-bit number from the key columns and the seed.

    md5 is used because other engines compute the same value from the same text.
    """
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def uniform(keys: Sequence[Column | str], seed: int | str) -> Column:
    """A value in [0, 1) fixed by the key and the seed."""
    return key_hash(keys, seed).cast("double") / F.lit(float(16**_HEX_DIGITS))


def poisson_sample(mean: Column, keys: Sequence[Column | str], seed: int = 42) -> Column:
    """A Poisson draw with the given mean per row; null mean gives null.

    Spark has no such function. The inverse distribution function at the row's
    uniform value, for any mean; above a mean of 500, where the first probability
    would vanish, it is summed from near the mean. Keyed by row, so a recomputed
    partition gives the same draw again.
    """
    import pandas as pd

    limit = _SUM_FROM_ZERO

    # Nested so that it travels by value and executors need no installed package.
    # Annotations are taken from these objects, since names are not resolved here.
    def draw(mean, u):
        import numpy as np
        import pandas as pd

        lam = mean.to_numpy(dtype="float64", na_value=np.nan)
        first = u.to_numpy(dtype="float64")
        out = np.full(lam.shape, np.nan)
        small = (lam >= 0) & (lam <= limit)
        large = lam > limit
        if small.any():
            rate = lam[small]
            target = first[small]
            pmf = np.exp(-rate)
            cdf = pmf.copy()
            k = np.zeros_like(rate)
            # 52-bit uniforms never exceed 1 - 2**-52; the bound ends the loop
            # where rounding keeps the summed distribution just below that.
            last = rate + 12.0 * np.sqrt(rate) + 30.0
            pending = (cdf <= target) & (k < last)
            while pending.any():
                k[pending] += 1.0
                pmf[pending] *= rate[pending] / k[pending]
                cdf[pending] += pmf[pending]
                pending = (cdf <= target) & (k < last)
            out[small] = k
        for i in np.flatnonzero(large):
            # the same inverse, from a start below which less than 1e-30 of the distribution lies;
            # probabilities relative to the first one are summed in logarithms
            reach = 12.0 * np.sqrt(lam[i]) + 30.0
            k = np.arange(max(0.0, np.floor(lam[i] - reach)), np.ceil(lam[i] + reach) + 1.0)
            log_pmf = np.concatenate([[0.0], np.cumsum(np.log(lam[i]) - np.log(k[1:]))])
            cdf = np.cumsum(np.exp(log_pmf - log_pmf.max()))
            at = np.searchsorted(cdf / cdf[-1], first[i], side="right")
            out[i] = k[min(at, len(k) - 1)]
        return pd.Series(out).astype("object").where(~np.isnan(out), None)

    draw.__annotations__ = {"mean": pd.Series, "u": pd.Series, "return": pd.Series}
    sampler = F.pandas_udf(draw, "double")
    return sampler(mean.cast("double"), uniform(keys, seed))
