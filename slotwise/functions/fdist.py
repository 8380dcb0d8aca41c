"""Upper tail of the F distribution as a native Column.

p = I_x(d2/2, d1/2) with x = d2/(d2 + d1 f): a factor times a continued fraction that runs until it no longer changes. The
fraction (in the form published by DiDonato and Morris, ACM TOMS 18, 1992) gets its argument as the distance from the
mean, (d1/2)(f - 1) x, and both x and 1 - x, so nothing cancels when the degrees of freedom are very large. Above the
mean it gives the tail itself, below it the other side.

For d1 up to 1e4, d2 from 1 to 1e12 and p above 1e-30 the relative error is below 1e-10.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Most terms; the slowest cases, f close to 1, need about 150.
_TERMS = 250
_SHIFT = 8


def _stirling_tail(z: str) -> str:
    series = "691D/360360"
    for c in ("1D/1188", "1D/1680", "1D/1260", "1D/360", "1D/12"):
        series = f"({c} - ({series})/({z}*{z}))"
    return f"{series}/{z}"


def _log_gamma(z: str) -> str:
    """ln Gamma(z) for z > 0: Stirling's series at z + 8, brought back by the recurrence."""
    y = f"({z} + {_SHIFT}D)"
    back = " * ".join(f"({z} + {j}D)" for j in range(_SHIFT))
    return f"({y} - 0.5D)*ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {_stirling_tail(y)} - ln({back})"


def _log_gamma_step(a: str, b: str) -> str:
    """ln Gamma(a + b) - ln Gamma(a), without cancellation when a is much larger than b."""
    y, yb = f"({a} + {_SHIFT}D)", f"({a} + {b} + {_SHIFT}D)"
    back = " - ".join(f"log1p({b}/({a} + {j}D))" for j in range(_SHIFT))
    return (f"({y} - 0.5D)*log1p({b}/{y}) + {b}*ln({yb}) - {b} + {_stirling_tail(yb)} - {_stirling_tail(y)} - {back}")


def _let(name: str, value: str, body: str) -> str:
    """Compute `value` once per row and use it under a name (a one-element transform)."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _fraction() -> str:
    """The continued fraction for v = (a, b, x, y, far): far is the distance a - (a + b) x from the mean."""
    top = "(1D/v.a + 1D)"
    w = "(n * (v.b - n) * v.x)"
    s = "(v.a + 2D*n - 1D)"
    p = "((n - 1D)/v.a + 1D)"
    alpha = f"{p} * ({p} + v.b/v.a) * (v.a/{s}) * (v.a/{s}) * {w} * v.x"
    beta = f"n + {w}/{s} + (n/v.a + 1D)/({top} + 2D*n/v.a) * (v.far + 1D + n*(v.y + 1D))"
    new = "struct(z.r/u.d AS an, 1D/u.d AS bn, u.n/u.d AS r, abs(u.n/u.d - z.r) <= 1e-15D * abs(u.n/u.d) AS done)"
    step = _let("k", f"struct({alpha} AS al, {beta} AS be)", _let(
        "u", "struct(k.al*z.an + k.be*z.r AS n, k.al*z.bn + k.be AS d)", new))
    first = f"({top}/(v.far + 1D))"
    return (f"aggregate(transform(sequence(1, {_TERMS}), i -> CAST(i AS DOUBLE)), struct(0D AS an, {first} AS bn, {first} AS r, false AS done), "
            f"(z, n) -> IF(z.done, z, {step}), z -> z.r)")


def f_survival(f: str, d1: str, d2: str) -> Column:
    """P(F(d1, d2) > f) for double columns; NULL when an argument is NULL."""
    # s = (a, b, r): half the degrees of freedom and the ratio d1 f / d2.
    x, y = "(1D/(1D + s.r))", "(s.r/(1D + s.r))"
    far = f"(s.b*({f} - 1D)*{x})"
    arguments = (
        f"IF({far} >= 0D, named_struct('a', s.a, 'b', s.b, 'x', {x}, 'y', {y}, 'far', {far}), "
        f"named_struct('a', s.b, 'b', s.a, 'x', {y}, 'y', {x}, 'far', -{far}))")
    large, small = "greatest(s.a, s.b)", "least(s.a, s.b)"
    log_front = (
        f"s.b*(ln(s.r) - log1p(s.r)) - s.a*log1p(s.r) + {_log_gamma_step(large, small)} - ({_log_gamma(small)})")
    part = _let("v", arguments, f"exp({log_front})*{_fraction()}")
    tail = _let("part", part, f"IF({far} >= 0D, part, 1D - part)")
    p = _let("s", f"named_struct('a', {d2}/2D, 'b', {d1}/2D, 'r', {d1}*{f}/{d2})", tail)
    return F.expr(
        f"CASE WHEN {f} IS NOT NULL AND {d1} IS NOT NULL AND {d2} IS NOT NULL "
        f"THEN IF({f} <= 0D, 1D, least(greatest({p}, 0D), 1D)) END")
