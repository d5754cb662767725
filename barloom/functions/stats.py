"""Tail probabilities of test statistics.

The rows these run on are aggregates (one per feature, model or series), so they are Arrow batches of a
few numbers; the heavy sums behind them are plain Spark aggregations.
"""

import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])(x)


def _settled(change: np.ndarray) -> bool:
    """Whether no value of a series or fraction moves any more (undefined ones never do)."""
    return not (np.abs(change) > 1e-14).any()


def beta_regularized(a, b, x) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction (modified Lentz form), until it settles."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in count(1):
            before = h
            for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                         -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + term * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + term / np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if _settled(h / before - 1):
                break
        out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


LARGE_SHAPE = 1e5  # from here on the uniform expansion is exact to 1e-10, and series would need thousands of terms


def _gamma_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower regularized incomplete gamma function of a large shape: normal tail of the deviance with its first correction."""
    away = x / a - 1
    deviance = np.where(np.abs(away) < 1e-3, away * away * (0.5 - away / 3 + away * away / 4 - away**3 / 5), away - np.log1p(away))
    eta = np.sign(away) * np.sqrt(2 * np.maximum(deviance, 0))
    near = np.abs(eta) < 1e-2
    safe = np.where(near, 1.0, away), np.where(near, 1.0, eta)
    first = np.where(near, -1 / 3 + eta / 12 - 2 * eta * eta / 135 + eta**3 / 864, 1 / safe[0] - 1 / safe[1])
    return _normal_cdf(eta * np.sqrt(a)) - np.exp(-a * deviance) / np.sqrt(2 * np.pi * a) * first


def gamma_regularized(a, x) -> np.ndarray:
    """Lower regularized incomplete gamma function: series for small x, continued fraction beyond, each until it settles;
    the uniform expansion for large shapes."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    large = a >= LARGE_SHAPE
    with np.errstate(all="ignore"):
        far = _gamma_large(a, x)
        series, rest = ~large & (x < a + 1), ~large & (x >= a + 1)
        scale = np.exp(-x + a * np.log(x) - _lgamma(a))
        term = np.where(series, 1 / a, 0.0)
        total = term.copy()
        for n in count(1):
            term = term * x / (a + n)
            total = total + term
            if _settled(term / np.where(series, total, 1.0)):
                break
        b = np.where(rest, x + 1 - a, 1.0)
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for n in count(1):
            an = np.where(rest, -n * (n - a), 0.0)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / np.where(np.abs(c) < 1e-300, 1e-300, c)
            change = np.where(rest, d * c, 1.0)
            h = h * change
            if _settled(change - 1):
                break
        out = np.where(large, far, np.where(series, scale * total, 1 - scale * h))
    return np.where(x <= 0, 0.0, np.clip(out, 0, 1))


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    v, s = df.astype(float).to_numpy(), t.astype(float).to_numpy()
    return pd.Series(beta_regularized(v / 2, 0.5, v / (v + s * s)), index=t.index).where(t.notna() & df.notna())


@pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    x, a, b = (s.astype(float).to_numpy() for s in (f, d1, d2))
    return pd.Series(beta_regularized(b / 2, a / 2, b / (b + a * x)), index=f.index).where(f.notna())


@pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series(1 - gamma_regularized(df.astype(float).to_numpy() / 2, x.astype(float).to_numpy() / 2), index=x.index).where(x.notna())


@pandas_udf(DoubleType())
def gamma_cdf(x: pd.Series, shape: pd.Series) -> pd.Series:
    return pd.Series(gamma_regularized(shape.astype(float).to_numpy(), x.astype(float).to_numpy()), index=x.index)


@pandas_udf(DoubleType())
def beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_regularized(a.astype(float).to_numpy(), b.astype(float).to_numpy(), x.astype(float).to_numpy()), index=x.index)


@pandas_udf(DoubleType())
def regression_f(gram: pd.Series, xy: pd.Series, yy: pd.Series, sy: pd.Series, n: pd.Series) -> pd.Series:
    """F statistic of a least-squares fit from its sums: X'X (row by row, intercept first), X'y, y'y, sum y, n."""
    out = []
    for g, b, q, s, m in zip(gram, xy, yy, sy, n):
        b = np.asarray(b, float)
        k = len(b) - 1
        explained = b @ np.linalg.lstsq(np.asarray(g, float).reshape(k + 1, k + 1), b, rcond=None)[0]
        rss, tss = q - explained, q - s * s / m
        out.append(((tss - rss) / k) / (rss / (m - k - 1)))
    return pd.Series(out, index=n.index)


def kolmogorov_upper(d: Column, n: Column) -> Column:
    """Asymptotic p-value of a Kolmogorov-Smirnov distance."""
    x = d * F.sqrt(n)
    terms = [((-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 101)]
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * sum(terms[1:], terms[0]))))
