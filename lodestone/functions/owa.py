"""Ordered weighted averages and fuzzy integrals of an array of values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import total


def descending(v: Column) -> Column:
    return F.reverse(F.array_sort(v))


def smoothing_weights(n: Column, alpha: float, form: int) -> Column:
    """Exponential smoothing weights of n values.

    Form 1 begins with alpha, multiplies by 1 - alpha, and ends with (1 - alpha) ** (n - 1); form 2
    ends with 1 - alpha, multiplies by alpha going back, and begins with alpha ** (n - 1).  They
    need not sum to 1; a single value weighs 1.
    """
    a, b = F.lit(float(alpha)), F.lit(1.0 - alpha)
    index = F.sequence(F.lit(0), n - 1)
    if form == 1:
        return F.transform(index, lambda i: F.when(i == n - 1, F.pow(b, i)).otherwise(a * F.pow(b, i)))
    return F.transform(index, lambda i: F.when(i == 0, F.pow(a, n - 1)).otherwise(b * F.pow(a, n - 1 - i)))


def quantifier_weights(n: Column, quantifier: Callable[[Column], Column]) -> Column:
    """Weights Q((i + 1) / n) - Q(i / n) of a regular increasing quantifier Q on [0, 1]."""
    index = F.sequence(F.lit(0), n - 1)
    return F.transform(index, lambda i: quantifier((i + 1) / n) - quantifier(i / n))


def ramp(low: float, high: float) -> Callable[[Column], Column]:
    """0 up to low, 1 from high on, linear between: "most" is ramp(.3, .8)."""
    return lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r - low) / (high - low)))


#: "at least half", "most" and "as many as possible".
QUANTIFIERS = {"owa1": ramp(0.0, 0.5), "owa2": ramp(0.3, 0.8), "owa3": ramp(0.5, 1.0)}


def weighted(v: Column, weights: Column) -> Column:
    """The weights applied to the values in descending order."""
    return total(F.zip_with(descending(v), weights, lambda x, w: x * w))


def choquet(v: Column, power: float = 1.0) -> Column:
    """Choquet integral with the cardinality measure (k / n) ** power of k of n criteria."""
    n = F.size(v)
    return weighted(v, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pow((i + 1) / n, F.lit(power)) - F.pow(i / n, F.lit(power))))


def choquet_symmetric(v: Column, power: float = 1.0) -> Column:
    """The integral of the positive parts less that of the negative parts."""
    part = lambda sign: F.transform(v, lambda x: F.greatest(sign * x, F.lit(0.0)))
    return choquet(part(1), power) - choquet(part(-1), power)


def sugeno(v: Column, power: float = 1.0) -> Column:
    """Sugeno integral with the same measure."""
    n = F.size(v)
    return F.array_max(F.transform(descending(v), lambda x, i: F.least(x, F.pow((i + 1) / n, F.lit(power)))))


def operator(name: str) -> Callable[[Column], Column]:
    """An aggregation of an array by name: mean, owa1-3, choquet, choquet_symmetric, sugeno, owa_exp_smooth{1,2}_{01..09}."""
    if name == "mean":
        return lambda v: total(v) / F.size(v)
    if name in QUANTIFIERS:
        return lambda v: weighted(v, quantifier_weights(F.size(v), QUANTIFIERS[name]))
    if name == "choquet":
        return choquet
    if name == "choquet_symmetric":
        return choquet_symmetric
    if name == "sugeno":
        return sugeno
    if name.startswith("owa_exp_smooth"):
        form, alpha = name.removeprefix("owa_exp_smooth").split("_")
        return lambda v: weighted(v, smoothing_weights(F.size(v), int(alpha) / 10, int(form)))
    raise ValueError(f"unknown aggregation: {name}")


OPERATORS = ["mean", *QUANTIFIERS, "choquet", "choquet_symmetric", "sugeno", *(f"owa_exp_smooth{f}_0{a}" for f in (1, 2) for a in range(1, 10))]
