"""Tails to 60 digits by power series, for tests."""

from decimal import Decimal as D
from decimal import getcontext
from functools import lru_cache

getcontext().prec = 60
PI = D("3.14159265358979323846264338327950288419716939937510582097494")
# Coefficients of Stirling's series.
STIRLING = [D(1) / 12, -D(1) / 360, D(1) / 1260, -D(1) / 1680, D(1) / 1188, -D(691) / 360360, D(1) / 156, -D(3617) / 122400,
            D(43867) / 244188, -D(174611) / 125400]


@lru_cache(maxsize=None)
def log_gamma(z):
    z, back = D(z), D(0)
    while z < 400:
        back -= z.ln()
        z += 1
    tail = sum(c / z**(2 * i + 1) for i, c in enumerate(STIRLING))
    return back + (z - D("0.5")) * z.ln() - z + (2 * PI).ln() / 2 + tail


def beta_series(a, b, x, y):
    """I_x(a, b), x + y = 1."""
    front = (a * x.ln() + b * y.ln() - log_gamma(a) - log_gamma(b) + log_gamma(a + b)).exp() / a
    term = total = D(1)
    n = 0
    while term > total * D(10)**-50:
        term *= (a + b + n) / (a + 1 + n) * x
        total += term
        n += 1
    return front * total


def f_tail(f, d1, d2):
    f, d1, d2 = D(f), D(d1), D(d2)
    x, y = d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f)
    return beta_series(d2 / 2, d1 / 2, x, y) if x < y else 1 - beta_series(d1 / 2, d2 / 2, y, x)


def gamma_series(a, x):
    """Lower regularized incomplete gamma function."""
    term = total = 1 / a
    n = 1
    while term > total * D(10)**-50:
        term *= x / (a + n)
        total += term
        n += 1
    return total * (a * x.ln() - x - log_gamma(a)).exp()


def chi2_tail(x, k):
    return 1 - gamma_series(D(k) / 2, D(x) / 2)
