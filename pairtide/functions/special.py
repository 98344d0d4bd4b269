"""Student-t tail probability, the one distribution Spark does not offer."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STEPS = 300
_TINY = 1e-300


def _log_gamma(z):
    """Stirling series after shifting the argument above 10."""
    shift = np.zeros_like(z)
    for _ in range(10):
        low = z < 10
        shift = shift + np.where(low, np.log(np.where(low, z, 1.0)), 0.0)
        z = np.where(low, z + 1, z)
    inverse = 1.0 / z
    tail = inverse / 12 - inverse**3 / 360 + inverse**5 / 1260 - inverse**7 / 1680
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail - shift


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < _TINY, _TINY, 1 - (a + b) * x / (a + 1))
    result = d
    for m in range(1, _STEPS + 1):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            result = result * d * c
    return result


def two_sided_p(t, df):
    """P(|T| >= |t|) for ``df`` degrees of freedom."""
    x = df / (df + t * t)
    a, b = df / 2.0, np.full_like(df, 0.5)
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    safe = np.clip(x, _TINY, 1 - 1e-16)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(safe) + b * np.log1p(-safe))
    value = np.where(x <= 0, 0.0, front * _beta_fraction(a, b, safe) / a)
    return np.where(swap, 1 - value, value)


@F.pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    known = t.notna() & df.notna()
    out = pd.Series(np.nan, index=t.index, dtype="float64")
    if known.any():
        out[known] = two_sided_p(t[known].to_numpy(dtype=float), df[known].to_numpy(dtype=float))
    return out
