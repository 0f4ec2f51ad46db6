import math
from decimal import Decimal, getcontext

import numpy as np
import pytest

from pathtide.functions.poisson import minus_log10_tail


def exact(k, lam):
    """-log10 P(X > k) by sums of 60 digits."""
    getcontext().prec = 60
    lam = Decimal(str(lam))
    log = -lam + k * lam.ln() - sum(Decimal(i).ln() for i in range(2, k + 1))
    term, total = Decimal(1), Decimal(0)
    i = k
    while True:
        i += 1
        term = term * lam / i
        total += term
        if term < total * Decimal("1e-30") and i > lam:
            return float(-(log + total.ln()) / Decimal(10).ln())


def test_small_counts_against_exact_sums():
    for k, lam in ((1, 0.5), (3, 3.0), (5, 9.5), (40, 12.25), (150, 149.0), (150, 151.0), (700, 650.0), (2000, 2000.0), (900, 1000.5)):
        assert minus_log10_tail(np.array([k]), np.array([lam]))[0] == pytest.approx(exact(k, lam), rel=1e-9, abs=1e-10)


def test_large_counts():
    # P(X > lam) nears a half: 1/2 - 2 / (3 sqrt(2 pi lam)) + ...
    for lam in (1e4, 1e5, 1e6, 1e7):
        half = 0.5 - 2 / 3 / math.sqrt(2 * math.pi * lam)
        assert minus_log10_tail(np.array([lam]), np.array([lam]))[0] == pytest.approx(-math.log10(half), abs=1e-7)
    # Far in the tail, mixed with small counts in one call.
    got = minus_log10_tail(np.array([1_005_000, 2.0, 0.0, 995_000, 1e7]), np.array([1e6, 1.0, 5.0, 1e6, 10.0]))
    i, term, terms = 1_005_001, 1.0, []
    while term > 1e-20:
        terms.append(term)
        i += 1
        term *= 1e6 / i
    far = -(-1e6 + 1_005_001 * math.log(1e6) - math.lgamma(1_005_002) + math.log(math.fsum(terms))) / math.log(10)
    assert got[0] == pytest.approx(far, abs=1e-7) and got[1] == pytest.approx(-math.log10(0.0803014), abs=1e-6)
    assert got[2] == 0 and 0 < got[3] < 1e-6 and got[4] == 1000
