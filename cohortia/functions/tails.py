"""Distribution tails in NumPy, applied to one row per feature or per test.

No numerical library beyond NumPy is available, so the regularised incomplete beta and
gamma functions come from their continued fractions and series (Abramowitz & Stegun 6.5, 26.5).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_TINY, _EPS, _STEPS = 1e-300, 1e-15, 500


def _each(f, x):
    a = np.asarray(x, dtype=float)
    return np.array([f(v) for v in a.ravel()]).reshape(a.shape)


def _lgamma(x):
    return _each(math.lgamma, x)


def _erfc(x):
    return _each(math.erfc, x)


def _nonzero(v):
    return np.where(np.abs(v) < _TINY, _TINY, v)


def _beta_fraction(x, a, b):
    """Modified Lentz evaluation of the continued fraction for I_x(a, b)."""
    c = np.ones_like(x)
    d = 1.0 / _nonzero(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, _STEPS):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / _nonzero(1.0 + num * d)
            c = _nonzero(1.0 + num / c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < _EPS):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = (np.atleast_1d(np.asarray(v, dtype=float)) for v in np.broadcast_arrays(a, b, x))
    out = np.where(np.isnan(x), np.nan, np.where(x <= 0, 0.0, 1.0))
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if ok.any():
        aa, bb, xx = a[ok], b[ok], x[ok]
        swap = xx > (aa + 1) / (aa + bb + 2)
        p, q, y = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        val = front * _beta_fraction(y, p, q)
        out[ok] = np.where(swap, 1 - val, val)
    return out


def gammaincc(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = (np.atleast_1d(np.asarray(v, dtype=float)) for v in np.broadcast_arrays(a, x))
    out = np.where(np.isnan(x), np.nan, np.where(x <= 0, 1.0, 0.0))
    low = (x > 0) & (x < a + 1)
    high = (x >= a + 1) & np.isfinite(x)
    if low.any():
        aa, xx = a[low], x[low]
        term = total = 1.0 / aa
        for n in range(1, _STEPS):
            term = term * xx / (aa + n)
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * _EPS):
                break
        out[low] = 1 - total * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c, d = np.full_like(xx, 1 / _TINY), 1 / _nonzero(b)
        h = d.copy()
        for n in range(1, _STEPS):
            an = -n * (n - aa)
            b = b + 2
            d = 1 / _nonzero(an * d + b)
            c = _nonzero(b + an / c)
            h = h * c * d
            if np.all(np.abs(c * d - 1) < _EPS):
                break
        out[high] = h * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    return out


def digamma(x):
    x = np.atleast_1d(np.asarray(x, dtype=float)).copy()
    out = np.zeros_like(x)
    while (x < 10).any():
        small = x < 10
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x):
    x = np.atleast_1d(np.asarray(x, dtype=float)).copy()
    out = np.zeros_like(x)
    while (x < 10).any():
        small = x < 10
        out[small] += 1 / x[small] ** 2
        x[small] += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66))))


def trigamma_inverse(y: float) -> float:
    """x > 0 with trigamma(x) = y, by bisection on a log scale."""
    lo, hi = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        if float(trigamma(mid)[0]) > y:
            lo = mid
        else:
            hi = mid
    return math.sqrt(lo * hi)


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    with np.errstate(invalid="ignore", divide="ignore"):
        return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


@pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p value of Student's t."""
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gammaincc(df.to_numpy(float) / 2, x.to_numpy(float) / 2))


@pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided p value of a standard normal."""
    return pd.Series(_erfc(np.abs(z.to_numpy(float)) / math.sqrt(2)))


@pandas_udf(DoubleType())
def hypergeom_upper(k: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    """P(X >= k) drawing ``drawn`` of ``total`` items of which ``marked`` are marked; log-gamma sums."""
    def lc(n, r):
        return _lgamma(n + 1.0) - _lgamma(r + 1.0) - _lgamma(n - r + 1.0)

    out = []
    for kk, n, m, t in zip(k, drawn, marked, total):
        top = int(min(n, m))
        i = np.arange(int(max(kk, n + m - t, 0)), top + 1, dtype=float)
        out.append(float(np.exp(lc(m, i) + lc(t - m, n - i) - lc(t, n)).sum()) if len(i) else 0.0)
    return pd.Series(np.minimum(out, 1.0))
