"""Tails of distributions, as column expressions and, where there is no closed form, as small functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A published polynomial for the normal tail, right to 7.5e-8.
P, B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_tail(z: Column) -> Column:
    """The chance of a standard normal value beyond |z| on one side."""
    x = F.abs(z)
    t = 1 / (1 + P * x)
    poly = sum((b * F.pow(t, F.lit(i + 2.0)) for i, b in enumerate(B[1:])), B[0] * t)
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly


NORMAL_TAIL_SQL = "(exp(-({0}) * ({0}) / 2) / sqrt(2 * pi()) * (" + " + ".join(f"({b}::DOUBLE) * pow(1 / (1 + {P}::DOUBLE * abs({{0}})), {i + 1})" for i, b in enumerate(B)) + "))"


def binomial_cdf(k: int, n: int, p: float) -> float:
    """The chance of k successes or fewer."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    total = 0.0
    for i in range(k + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, total)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The exact interval: the chances at which k or more, and k or fewer, successes have half of alpha."""

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    if n == 0:
        return 0.0, 1.0
    return (0.0 if k == 0 else solve(lambda p: 1 - binomial_cdf(k - 1, n, p) < alpha / 2), 1.0 if k == n else solve(lambda p: binomial_cdf(k, n, p) > alpha / 2))
