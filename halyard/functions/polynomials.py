"""One-dimensional bases as Column expressions: value and first two derivatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _coefficients(degree: int, step) -> list[float]:
    """Ascending monomial coefficients of p_degree where p_{n+1} = step(n, x p_n, p_n, p_{n-1}).

    Built on plain lists: degrees are small and the result is a constant of the plan.
    """
    before, now = [], [1.0]
    for n in range(degree):
        a, b = step(n)
        shifted = [0.0] + [a * c for c in now]
        for k, c in enumerate(before):
            shifted[k] -= b * c
        before, now = now, shifted
    return now


_STEPS = {"canonical": lambda n: (1.0, 0.0), "hermite": lambda n: (1.0, float(n)), "tchebychev": lambda n: (1.0 if n == 0 else 2.0, 1.0), "legendre": lambda n: ((2 * n + 1) / (n + 1), n / (n + 1))}


def coefficients(family: str, degree: int, derivative: int = 0) -> list[float]:
    """Ascending coefficients of the given derivative; hermite is the probabilists' family."""
    found = _coefficients(degree, _STEPS[family])
    for _ in range(derivative):
        found = [k * c for k, c in enumerate(found)][1:] or [0.0]
    return found


def basis(family: str, degree: int, x: Column, derivative: int = 0) -> Column:
    """The polynomial at x by Horner's rule, null where x is null."""
    found = coefficients(family, degree, derivative)
    out = F.lit(found[-1]) + x * 0.0
    for c in reversed(found[:-1]):
        out = out * x + F.lit(c)
    return out


def hat(t: Column) -> Column:
    """Hierarchical linear basis, zero beyond one half width."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(t))


def quadratic(t: Column) -> Column:
    return F.when(F.abs(t) < 1, (1.0 + t) * (1.0 - t)).otherwise(F.lit(0.0))


def cubic(t: Column, left: bool) -> Column:
    body = (t * t - 1.0) * (t - 3.0) / 3.0 if left else (1.0 - t * t) * (t + 3.0) / 3.0
    return F.when(F.abs(t) < 1, body).otherwise(F.lit(0.0))
