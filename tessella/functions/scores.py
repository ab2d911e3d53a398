"""Row-wise scores, gates and verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bands(x: Column, limits: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first limit that x reaches."""
    out = F.lit(rest)
    for limit, name in reversed(limits):
        out = F.when(x >= limit, F.lit(name)).otherwise(out)
    return out


#: Risk bands of a score.
RISK = [(0.85, "CRITICAL"), (0.65, "HIGH"), (0.35, "MEDIUM")]
#: Verdict bands.
VERDICT = [(0.85, "PLAGIARIZED"), (0.60, "SUSPICIOUS"), (0.30, "CLEAN")]


def risk(score: Column) -> Column:
    return bands(score, RISK, "LOW")


def verdict(score: Column) -> Column:
    return bands(score, VERDICT, "UNCERTAIN")


def subtract_baseline(score: Column, baseline: Column) -> Column:
    return clamp((score - baseline) / F.greatest(F.lit(0.01), 1 - baseline))


def hard_gate(features: list[Column], structural: list[Column], coverage: Column) -> Column:
    """True where a pair is cleared whatever its score: weak features, weak structure, or little coverage."""
    highest = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
    top, built = highest(features), highest(structural)
    return (top < 0.5) | (built < 0.5) | (coverage < 0.15) | ((top >= 0.8) & (coverage < 0.4))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in parts)
    out = F.lit(0.0)
    for x, w in parts:
        out = out + x * (w / total)
    return out


def logistic(parts: list[tuple[Column, float]], intercept: float, limit: float = 30.0) -> Column:
    z = F.lit(intercept)
    for x, w in parts:
        z = z + x * w
    return 1 / (1 + F.exp(-clamp(z, -limit, limit)))


def agreement(scores: list[Column]) -> tuple[Column, Column]:
    """Mean and population standard deviation of several scores of a row."""
    n = len(scores)
    mean = sum(scores[1:], scores[0]) / n
    square = sum([s * s for s in scores[1:]], scores[0] * scores[0]) / n
    return mean, F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))


def consensus(scores: list[Column]) -> Column:
    """Mean, lowered by twice the spread."""
    mean, spread = agreement(scores)
    return mean * F.greatest(F.lit(0.0), 1 - 2 * spread)
