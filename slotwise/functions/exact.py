"""Sums that do not depend on the order of rows.

A double is split into its whole part and billionths, both whole numbers, whose sums are exact in any order.
Money and KPIs in steps of 1e-9 or more add up without any loss; finer digits are rounded once per value. Text in, SQL
text out: x is a double, w and b are the sums of its two parts.
"""

from __future__ import annotations

# Larger values, infinities and NaN count as missing.
_LIMIT = "9e15D"
_SCALE = 1_000_000_000


def known(x: str) -> str:
    """The value if it can be summed, else NULL."""
    return f"CASE WHEN abs({x}) < {_LIMIT} THEN {x} END"


def whole(x: str) -> str:
    return f"floor({x})"


def billionths(x: str) -> str:
    return f"CAST(rint(({x} - floor({x})) * 1e9D) AS BIGINT)"


def sums(x: str, w: str, b: str) -> list[str]:
    """Aggregates of a double: the sums of its parts, as w and b."""
    return [f"sum({whole(x)}) AS {w}", f"sum({billionths(x)}) AS {b}"]


def _scaled(w: str, b: str) -> str:
    """The sum in billionths."""
    return f"(CAST({w} AS DECIMAL(38, 0)) * {_SCALE} + {b})"


def total(w: str, b: str) -> str:
    """The sum as a double, the same for equal sums; NULL for none."""
    return f"(CAST({w} + {b} DIV {_SCALE} AS DOUBLE) + CAST({b} % {_SCALE} AS DOUBLE) / 1e9D)"


def centre(n: str, w: str, b: str) -> str:
    """The whole number next to the mean."""
    return f"CAST(floor(try_divide({total(w, b)}, CAST({n} AS DOUBLE)) + 0.5D) AS BIGINT)"


def centred_sum(n: str, w: str, b: str, c: str) -> str:
    """Sum of x - c, from exact sums."""
    return f"(CAST({_scaled(w, b)} - CAST({n} AS DECIMAL(38, 0)) * {c} * {_SCALE} AS DOUBLE) / 1e9D)"


def centred_squares(n: str, w: str, b: str, qw: str, qb: str, c: str) -> str:
    """Sum of (x - c)^2; qw and qb are the sums of the squares' parts."""
    large = f"CAST({c} AS DECIMAL(38, 0))"
    return (f"(CAST({_scaled(qw, qb)} - 2 * {large} * {_scaled(w, b)} + {large} * {large} * {n} * {_SCALE} AS DOUBLE) / 1e9D)")
