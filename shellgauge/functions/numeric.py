"""Column arithmetic shared by scoring and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def clamp(p: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), p))


def logit(p: Column) -> Column:
    """Log odds with p kept inside [EPS, 1 - EPS]."""
    q = clamp(p, EPS, 1.0 - EPS)
    return F.log(q / (1.0 - q))


def sigmoid(x: Column) -> Column:
    """Logistic function in the form that cannot overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def platt(p: Column, a: Column, b: Column) -> Column:
    return sigmoid(a * logit(p) + b)


def array_total(values: Column) -> Column:
    """Sum of an array of doubles, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def temper(probs: Column, t: Column) -> Column:
    """Softmax of log p / t over one probability array, floored at EPS."""
    from shellgauge.functions.text import let

    logs = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(EPS))) / t)
    shifted = let(logs, lambda ls: let(F.array_max(ls), lambda top: F.transform(ls, lambda x: F.exp(x - top))))
    return let(shifted, lambda es: let(array_total(es), lambda total: F.transform(es, lambda e: e / total)))


def is_finite(x: Column) -> Column:
    """A number; NaN sorts above infinity."""
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
