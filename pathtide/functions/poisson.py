"""Poisson tail as a vectorised column function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Highest p-value in -log10, taken where the tail vanishes.
CAP = 1000.0


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def _log_term(i: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """ln P(X = i); for large i by Stirling's series with the large terms taken together, where they nearly cancel."""
    x = np.maximum(i, 1.0)
    apart = (lam - x) / x
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    near = -x * (apart - np.log1p(np.maximum(apart, -1 + 1e-300))) - 0.5 * np.log(2 * np.pi * x) - series
    return np.where(i > 100, near, -lam + i * np.log(lam) - _log_gamma(i + 1))


def _falling_sum(ratio: Callable[[int, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """1 + r(2) + r(2) r(3) + ... for ``n`` series of ratios below 1, each until its terms no longer count."""
    out, left = np.ones(n), np.arange(n)
    term, total, i = np.ones(n), np.ones(n), 2
    while len(left):
        for _ in range(64):
            term = term * ratio(i, left)
            total = total + term
            i += 1
        out[left] = total
        on = term > 1e-17 * total
        left, term, total = left[on], term[on], total[on]
    return out


def minus_log10_tail(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """-log10 P(X > k) for Poisson(lam); 0 where k is 0, the cap where the tail is 0.

    From k = lam on the upper tail's terms are summed, below it the lower ones are taken from 1. The
    terms fall off within some roots of k, so the sum ends when they no longer count.
    """
    k, lam = np.asarray(k, dtype=float), np.maximum(np.asarray(lam, dtype=float), 1e-300)
    whole = np.floor(k)
    out = np.zeros_like(lam)
    high = whole >= lam
    if high.any():
        kk, ll = whole[high], lam[high]
        out[high] = -(_log_term(kk + 1, ll) + np.log(_falling_sum(lambda i, at: ll[at] / (kk[at] + i), len(kk)))) / np.log(10)
    low = ~high
    if low.any():
        kk, ll = whole[low], lam[low]
        total = np.exp(_log_term(kk, ll)) * _falling_sum(lambda i, at: np.maximum(kk[at] - i + 2, 0) / ll[at], len(kk))
        out[low] = -np.log10(np.maximum(1 - total, 0), where=total < 1, out=np.full_like(total, CAP))
    out = np.where(np.isfinite(out), np.minimum(out, CAP), CAP)
    return np.where(k == 0, 0.0, out)


@F.pandas_udf(DoubleType())
def poisson_p(k: pd.Series, lam: pd.Series) -> pd.Series:
    """p-value in -log10 of ``k`` under a background of ``lam``. Use it on distinct pairs."""
    return pd.Series(minus_log10_tail(k.to_numpy(), lam.to_numpy()))
