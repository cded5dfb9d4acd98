"""Tail probabilities of the t, F and chi-square distributions.

Spark SQL has no incomplete beta or gamma function, so these run as Arrow
batched pandas UDFs.  They are applied to *result* rows only (one row per
test), never to data rows.  The numerics are the textbook continued-fraction
(modified Lentz) and series expansions of the regularised incomplete beta
and gamma functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300
_ITER = 20_000          # a tail that has not settled by then is reported as missing
_LARGE = 1e4            # from this shape on, the gamma tail is taken from its uniform expansion

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _lg(x):
    return _lgamma(np.asarray(x, dtype=float)).astype(float)


def _lg_ratio(a, b):
    """ln(Gamma(a + b) / Gamma(a)) for a > 0, b > 0; Stirling differences where plain ones cancel."""
    a, b = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(b, dtype=float))
    with np.errstate(over="ignore", invalid="ignore"):
        z = a + b
        stirling = ((a - 0.5) * np.log1p(b / a) + b * np.log(z) - b + (1 / z - 1 / a) / 12 - (z ** -3.0 - a ** -3.0) / 360)
    return np.where(a > 100, stirling, _lg(a + b) - _lg(a))


def _betacf(a, b, x):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, _ITER + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < _EPS * 4):
            break
    return np.where(np.abs(delta - 1.0) < 1e-12, h, np.nan)


def betainc(a, b, x, y=None):
    """Regularised incomplete beta I_x(a, b), element-wise; ``y`` = 1 - x, where the caller knows it better."""
    y = 1.0 - np.asarray(x, dtype=float) if y is None else y
    a, b, x, y = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x, y))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (y <= 0)] = 1.0
    mid = ok & (x > 0) & (y > 0)
    if mid.any():
        am, bm, xm, ym = a[mid], b[mid], x[mid], y[mid]
        big, small = np.maximum(am, bm), np.minimum(am, bm)
        log_x = np.where(xm > 0.5, np.log1p(-ym), np.log(xm))
        log_y = np.where(ym > 0.5, np.log1p(-xm), np.log(ym))
        bt = np.exp(_lg_ratio(big, small) - _lg(small) + am * log_x + bm * log_y)
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = bt[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        flip = ~direct
        if flip.any():
            res[flip] = 1.0 - bt[flip] * _betacf(bm[flip], am[flip], ym[flip]) / bm[flip]
        out[mid] = res
    return out


def _gammaincc_large(a, x):
    """Q(a, x) for large a: Temme's uniform expansion (DLMF 8.12), two terms."""
    mu = x / a - 1.0
    eta = np.sign(mu) * np.sqrt(2.0 * np.maximum(mu - np.log1p(mu), 0.0))
    near = np.abs(eta) < 0.05
    m, e = np.where(near, 1.0, mu), np.where(near, 1.0, eta)
    c0 = np.where(near, -1 / 3 + eta / 12 - 2 * eta ** 2 / 135 + eta ** 3 / 864 + eta ** 4 / 2835, 1 / m - 1 / e)
    c1 = np.where(near, -1 / 540 - eta / 288 + 25 * eta ** 2 / 12096, 1 / e ** 3 - 1 / m ** 3 - 1 / m ** 2 - 1 / (12 * m))
    rest = np.exp(-0.5 * a * eta ** 2) / np.sqrt(2 * np.pi * a) * (c0 + c1 / a)
    return np.clip(0.5 * _erfc(eta * np.sqrt(a / 2)).astype(float) + rest, 0.0, 1.0)


def gammaincc(a, x):
    """Regularised upper incomplete gamma Q(a, x), element-wise."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & (a > 0) & ~np.isnan(x)
    out[ok & (x <= 0)] = 1.0
    out[ok & np.isposinf(x)] = 0.0
    mid = ok & (x > 0) & np.isfinite(x)
    if not mid.any():
        return out
    am, xm = a[mid], x[mid]
    res = np.empty_like(xm)
    gln = _lg(am)
    large = am >= _LARGE
    if large.any():
        res[large] = _gammaincc_large(am[large], xm[large])
    ser = ~large & (xm < am + 1.0)
    if ser.any():
        aa, xx = am[ser], xm[ser]
        ap = aa.copy()
        s = 1.0 / aa
        dl = s.copy()
        for _ in range(_ITER):
            ap = ap + 1.0
            dl = dl * xx / ap
            s = s + dl
            if np.all(np.abs(dl) < np.abs(s) * _EPS):
                break
        s = np.where(np.abs(dl) < np.abs(s) * 1e-12, s, np.nan)
        res[ser] = 1.0 - s * np.exp(-xx + aa * np.log(xx) - gln[ser])
    cf = ~large & ~ser
    if cf.any():
        aa, xx = am[cf], xm[cf]
        b = xx + 1.0 - aa
        c = np.full_like(xx, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, _ITER + 1):
            an = -i * (i - aa)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1.0) < _EPS * 4):
                break
        h = np.where(np.abs(delta - 1.0) < 1e-12, h, np.nan)
        res[cf] = np.exp(-xx + aa * np.log(xx) - gln[cf]) * h
    out[mid] = res
    return out


def t_sf2(t, df):
    """Two-sided tail P(|T| > |t|) of Student's t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_sf(f, d1, d2):
    """Upper tail P(F > f) of the F distribution."""
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    g = d1 * np.maximum(f, 0)
    out = betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + g), g / (d2 + g))
    return np.where(np.isposinf(f), 0.0, out)


def chi2_sf(x, k):
    """Upper tail P(X > x) of chi-square with ``k`` degrees of freedom."""
    return gammaincc(np.asarray(k, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


def _clean(s: pd.Series) -> np.ndarray:
    return pd.to_numeric(s, errors="coerce").astype(float).to_numpy()


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf2(_clean(t), _clean(df)))


@F.pandas_udf(T.DoubleType())
def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(_clean(f), _clean(d1), _clean(d2)))


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(_clean(x), _clean(k)))


def t_pvalue(t: Column, df: Column) -> Column:
    return _t_p(t.cast("double"), df.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return _f_p(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_pvalue(x: Column, k: Column) -> Column:
    return _chi2_p(x.cast("double"), k.cast("double"))
