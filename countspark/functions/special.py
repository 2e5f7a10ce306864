"""Special functions missing from Spark and numpy: log-gamma, polygamma, incomplete beta, and the tails built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def erfc(x) -> np.ndarray:
    """Complementary error function: a series of positive terms near zero, a continued fraction in the tails."""
    x = np.asarray(x, dtype=float)
    a = np.abs(np.where(np.isnan(x), 0.0, x))
    near = a < 2.0
    z = np.where(near, a, 0.0)
    term, total = np.ones_like(z), np.ones_like(z)
    for n in range(1, 80):
        term = term * 2 * z * z / (2 * n + 1)
        total = total + term
    small = 1 - 2 / math.sqrt(math.pi) * z * np.exp(-z * z) * total
    t = np.where(near, 2.0, np.minimum(a, 1e8))
    tail = np.zeros_like(t)
    for n in range(120, 0, -1):
        tail = n / 2 / (t + tail)
    large = np.exp(-np.minimum(t * t, 745.0)) * (t * t < 745.0) / math.sqrt(math.pi) / (t + tail)
    upper = np.where(near, small, large)
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 2 - upper, upper))


def normal_upper_quantile(p) -> np.ndarray:
    """z with P(Z > z) = p, 0 < p <= 0.5, by bisection on all values at once."""
    p = np.asarray(p, dtype=float)
    lo, hi = np.zeros_like(p), np.full_like(p, 38.6)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = erfc(mid / math.sqrt(2)) / 2 > p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def lgamma(x) -> np.ndarray:
    """log Γ(x) for x > 0: Stirling's series after shifting the argument to at least 8."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    inv = 1 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def digamma(x: float) -> float:
    total = 0.0
    while x < 8:
        total -= 1 / x
        x += 1
    inv = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))


def trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total += 1 / (x * x)
        x += 1
    inv = 1 / (x * x)
    return total + 1 / x + inv / 2 + inv / x * (1 / 6 - inv * (1 / 30 - inv * (1 / 42 - inv / 30)))


def trigamma_inverse(y: float) -> float:
    """x with trigamma(x) = y, by bisection on the logarithm."""
    lo, hi = math.log(1e-8), math.log(1e10)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if trigamma(math.exp(mid)) > y else (lo, mid)
    return math.exp((lo + hi) / 2)


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), vectorised."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inner = np.clip(z, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(inner) + q * np.log1p(-inner)) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * inner / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * inner / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * inner / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    value = np.where(z <= 0, 0.0, np.clip(front * h, 0, 1))
    return np.where(flip, 1 - value, value)


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| ≥ |t|) of Student's t; an infinite df gives the normal tail."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    finite = np.where(np.isfinite(df), df, 1.0)
    return np.where(np.isfinite(df), betainc(finite / 2, 0.5, finite / (finite + t * t)), erfc(np.abs(t) / math.sqrt(2)))


def t_quantiles(p, df) -> np.ndarray:
    """Upper quantiles: x with P(T ≤ x) = p, p > 0.5; bisection on the logarithm for all values at once."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    lo, hi = np.full(p.shape, math.log(1e-12)), np.full(p.shape, math.log(1e12))
    for _ in range(70):
        mid = (lo + hi) / 2
        below = 1 - t_two_sided(np.exp(mid), df) / 2 < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.exp((lo + hi) / 2)


def t_quantile(p: float, df: float) -> float:
    """One upper quantile."""
    return float(t_quantiles(p, df))


def f_quantile(p: float, d1: float, d2: float) -> float:
    """x with P(F ≤ x) = p."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if betainc(d1 / 2, d2 / 2, d1 * mid / (d1 * mid + d2)) < p else (lo, mid)
    return (lo + hi) / 2


def f_tail(f, d1: float, d2: float) -> np.ndarray:
    """P(F ≥ f)."""
    f = np.maximum(np.asarray(f, float), 0)
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal tail of a z statistic; NULL stays NULL."""
    return pd.Series(np.where(z.isna(), np.nan, erfc(np.abs(z.fillna(0).to_numpy()) / math.sqrt(2))))


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided t tail; NULL stays NULL."""
    return pd.Series(np.where(t.isna(), np.nan, t_two_sided(t.fillna(0).to_numpy(), df.to_numpy())))


def quadratic_ratio_tail(weights: np.ndarray, share: float) -> float:
    """P(Σ wᵢ zᵢ² / Σ zᵢ² >= share) for independent standard normal z, one per weight.

    It is the chance that Σ (wᵢ - share) zᵢ² is positive, by inversion of the characteristic function; small chances are integrated through the
    saddle point of the cumulant function, where nothing cancels, so they keep their relative accuracy.
    """
    weights = np.asarray(weights, dtype=float)
    top = np.abs(weights).max(initial=0.0)
    if top == 0 or not np.isfinite(share):
        return math.nan
    a = (weights - share) / top
    a[np.abs(a) < 1e-12] = 0.0
    if not (a > 0).any():
        return 0.0 if (a < 0).any() else 1.0
    if not (a < 0).any():
        return 1.0
    u = np.exp(np.linspace(-40, 60, 4001))  # the integrand falls exponentially at both ends in log u, so equal steps are exact
    product = a[:, None] * u
    angle = 0.5 * np.arctan(product).sum(axis=0)
    size = np.exp(-0.25 * np.log1p(product * product).sum(axis=0))
    p = 0.5 + (np.sin(angle) * size).sum() * 0.025 / math.pi
    if p > 1e-3:
        return float(min(p, 1.0))
    low, high = 0.0, 0.5 / a.max()  # the slope of the cumulant function rises from below zero to infinity
    slope = lambda z: (a / (1 - 2 * z * a)).sum()
    for _ in range(200):
        z = (low + high) / 2
        low, high = (z, high) if slope(z) < 0 else (low, z)
    line = z + 1j * z * u
    value = np.exp(-0.5 * np.log(1 - 2 * line[:, None] * a).sum(axis=1)) / line
    return float((value.real * z * u).sum() * 0.025 / math.pi)
