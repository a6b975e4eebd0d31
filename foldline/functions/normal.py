"""Inverse normal distribution as a column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rational approximation of the inverse normal distribution by
# P. J. Acklam (relative error below 1.15e-9): central numerator and denominator, tail numerator and
# denominator, and the probability at which the tail form takes over.
CENTRAL_NUM = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
CENTRAL_DEN = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0,
)
TAIL_NUM = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_START = 0.02425


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def probit(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside (0, 1)."""
    q = p - 0.5
    r = q * q
    middle = q * _poly(CENTRAL_NUM, r) / _poly(CENTRAL_DEN, r)
    t = F.sqrt(F.log(F.least(p, 1 - p)) * -2.0)
    tail = _poly(TAIL_NUM, t) / _poly(TAIL_DEN, t)
    inside = (p > 0) & (p < 1)
    return F.when(
        inside,
        F.when(p < TAIL_START, tail).when(p > 1 - TAIL_START, -tail).otherwise(middle),
    )


def probit_sql(p: str) -> str:
    """The same expression as SQL text."""

    def poly(cs: Sequence[float], x: str) -> str:
        acc = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            acc = f"({acc} * {x} + ({c!r}))"
        return acc

    r = f"(({p} - 0.5) * ({p} - 0.5))"
    t = f"sqrt(-2.0 * ln(least({p}, 1 - {p})))"
    tail = f"{poly(TAIL_NUM, t)} / {poly(TAIL_DEN, t)}"
    middle = f"({p} - 0.5) * {poly(CENTRAL_NUM, r)} / {poly(CENTRAL_DEN, r)}"
    return (
        f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN {p} < {TAIL_START} THEN {tail} "
        f"WHEN {p} > 1 - {TAIL_START} THEN -({tail}) ELSE {middle} END END"
    )
