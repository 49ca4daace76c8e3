"""Student's t distribution in numpy, for Arrow-vectorised use on aggregated rows."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, steps):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = (np.asarray(v, dtype=np.float64) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.clip(np.where(swap, 1 - x, x), 0, 1)
    gamma = np.vectorize(lgamma)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) + gamma(p + q) - gamma(p) - gamma(q)) / p
        out = np.where(y <= 0, 0.0, front * beta_fraction(p, q, y))
    return np.where(swap, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); NaN in gives NaN out."""
    t, df = np.asarray(t, dtype=np.float64), np.asarray(df, dtype=np.float64)
    ok = np.isfinite(t) & (df > 0)
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, incomplete_beta(safe_df / 2, np.full_like(safe_df, 0.5), safe_df / (safe_df + safe_t**2)), np.nan)


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """The t below which lies probability ``p`` (above one half), by bisection."""
    df = np.asarray(df, dtype=np.float64)
    ok = df > 0
    safe = np.where(ok, df, 1.0)
    low, high = np.zeros_like(safe), np.full_like(safe, 1e6)
    for _ in range(200):
        middle = (low + high) / 2
        below = 1 - t_two_sided(middle, safe) / 2 < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return np.where(ok, (low + high) / 2, np.nan)


def p_value(t, df):
    """Two-sided p value of t statistics in a column; null where either is missing."""

    @F.pandas_udf("double")
    def of(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t.to_numpy(np.float64, na_value=np.nan), df.to_numpy(np.float64, na_value=np.nan))).where(lambda s: s.notna(), None)

    return of(t, df)


def quantile(p: float):
    """A column function: the t quantile at ``p`` for given degrees of freedom."""

    @F.pandas_udf("double")
    def of(df: pd.Series) -> pd.Series:
        return pd.Series(t_quantile(p, df.to_numpy(np.float64, na_value=np.nan))).where(lambda s: s.notna(), None)

    return of
