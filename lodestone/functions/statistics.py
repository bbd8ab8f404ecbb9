"""Distribution functions, losses and poolings as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import erf, softmax


#: Added to what is divided by, it keeps 0 out and changes no other value.
_TINY = 1e-300


def _fraction(first: np.ndarray | float, steps: int, step: Callable[[int], tuple[np.ndarray | float, np.ndarray | float]]) -> np.ndarray:
    """Lentz's way through a continued fraction 1 / (b0 + a1 / (b1 + ...)) of many values at once: step gives a and b of a
    number, first is 1 / b0."""
    d, c = first, 1 / _TINY
    h = d
    for i in range(1, steps + 1):
        a, b = step(i)
        d, c = 1 / (a * d + b + _TINY), b + a / c + _TINY
        h = h * (d * c)
    return h


def _by_value(f: Callable[[np.ndarray], np.ndarray], x: Column) -> Column:
    """f(x) of doubles, batch by batch, each distinct value of a batch once; null stays null, NaN NaN."""

    def of(values: pa.Array) -> pa.Array:
        v, at = np.unique(values.fill_null(0.0).to_numpy(zero_copy_only=False), return_inverse=True)
        out, known = np.full(len(v), np.nan), ~np.isnan(v)
        with np.errstate(all="ignore"):
            out[known] = f(v[known])
        return pa.array(out[at], mask=values.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(of, "double")(x.cast("double"))


def gamma_p(a: float, x: Column) -> Column:
    """The regularised lower incomplete gamma function for a above 0: by its series up to a + 1, beyond as 1 less a
    continued fraction.  The terms are as many as the slowest place, around a + 1, needs for 12 digits."""
    terms = int(40 + 10 * math.sqrt(a))
    front = lambda z: np.exp(a * np.log(z) - z - math.lgamma(a))

    def at(v: np.ndarray) -> np.ndarray:
        out = np.where(v <= 0, 0.0, 1.0)
        inside, beyond = (v > 0) & (v < a + 1), (v >= a + 1) & np.isfinite(v)
        low, high = v[inside], v[beyond]
        term = np.full(len(low), 1.0 / a)
        total = term.copy()
        for n in range(1, terms):
            term = term * low / (a + n)
            total += term
        out[inside] = front(low) * total
        out[beyond] = 1 - front(high) * _fraction(1 / (high + 1 - a), terms, lambda i: (i * (a - i), high + 1 - a + 2 * i))
        return out

    return _by_value(at, x)


def beta_i(a: float, b: float, x: Column) -> Column:
    """The regularised incomplete beta function for a and b above 0: a continued fraction, from the nearer end."""
    terms = 2 * int(24 + 5 * math.sqrt(max(a, b)))
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    turn = (a + 1) / (a + b + 2)
    power = lambda z: np.exp(front + a * np.log(z) + b * np.log(1 - z))

    def fraction(p: float, q: float, v: np.ndarray) -> np.ndarray:
        # The first step is odd, with m = 0.
        def step(i: int) -> tuple[np.ndarray, float]:
            m = i // 2
            odd, even = -(p + m) * (p + q + m) / ((p + i - 1) * (p + i)), m * (q - m) / ((p + i - 1) * (p + i))
            return (odd if i % 2 else even) * v, 1.0

        return _fraction(1.0, terms, step)

    def at(v: np.ndarray) -> np.ndarray:
        out = np.where(v <= 0, 0.0, 1.0)
        inside, beyond = (v > 0) & (v < turn), (v >= turn) & (v < 1)
        low, high = v[inside], v[beyond]
        out[inside] = power(low) * fraction(a, b, low) / a
        out[beyond] = 1 - power(high) * fraction(b, a, 1 - high) / b
        return out

    return _by_value(at, x)


def cdf(distribution: str, x: Column, params: list[float]) -> Column:
    """The distribution function at x; the last two parameters are location and scale."""
    *_, loc, scale = params
    z = (x - loc) / scale
    # Tasks get the arguments of all rows, also of those that another branch is for.
    above = F.when(z > 0, z)
    known = {
        "norm": lambda: 0.5 * (1 + erf(z / 2**0.5)),
        "uniform": lambda: F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)),
        "expon": lambda: F.when(z > 0, 1 - F.exp(-z)).otherwise(0.0),
        "logistic": lambda: 1 / (1 + F.exp(-z)),
        "laplace": lambda: F.when(z < 0, 0.5 * F.exp(z)).otherwise(1 - 0.5 * F.exp(-z)),
        "gumbel_r": lambda: F.exp(-F.exp(-z)),
        "cauchy": lambda: 0.5 + F.atan(z) / 3.141592653589793,
        "pareto": lambda: F.when(z > 1, 1 - F.pow(z, F.lit(-float(params[0])))).otherwise(0.0),
        "gumbel_l": lambda: 1 - F.exp(-F.exp(z)),
        "halfnorm": lambda: F.when(z > 0, erf(z / 2**0.5)).otherwise(0.0),
        "weibull_min": lambda: F.when(z > 0, 1 - F.exp(-F.pow(z, F.lit(float(params[0]))))).otherwise(0.0),
        "lognorm": lambda: F.when(z > 0, 0.5 * (1 + erf(F.log(z) / (params[0] * 2**0.5)))).otherwise(0.0),
        "gamma": lambda: gamma_p(params[0], z),
        "invgamma": lambda: F.when(z > 0, 1 - gamma_p(params[0], 1 / above)).otherwise(0.0),
        "chi2": lambda: gamma_p(params[0] / 2, z / 2),
        "beta": lambda: beta_i(params[0], params[1], z),
        "betaprime": lambda: F.when(z > 0, beta_i(params[0], params[1], above / (1 + above))).otherwise(0.0),
        "f": lambda: F.when(z > 0, beta_i(params[0] / 2, params[1] / 2, params[0] * above / (params[0] * above + params[1]))).otherwise(0.0),
        "t": lambda: F.when(z > 0, 1 - 0.5 * beta_i(params[0] / 2, 0.5, params[0] / (params[0] + z * z))).otherwise(0.5 * beta_i(params[0] / 2, 0.5, params[0] / (params[0] + z * z))),
    }
    if distribution not in known:
        raise ValueError(f"no distribution {distribution}")
    return known[distribution]()


def cdf_normalised(x: Column, distribution: str, params: list[float], low: float, high: float) -> Column:
    """The distribution function of x brought into [low, high]; in [0, 1]."""
    inside = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cdf(distribution, inside, params)))


def cross_entropy(logits: Column, label: Column, ignore: int = -1) -> Column:
    """Minus the log of the label's probability; null where the label is to be ignored."""
    return F.when(label != ignore, -F.ln(F.get(softmax(logits), label)))


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda s, t: F.zip_with(s, t, lambda x, y: x + y))


def _beside(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda s, t: F.concat(s, t))


def _mean(tokens: Column) -> Column:
    n = F.size(tokens)
    width = F.size(F.get(tokens, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda h: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.get(t, h)) / n)


POOLINGS = ["average-sum-4", "average-sum-2", "average-cat-4", "average-cat-2", "average-1", "average-2", "average-3", "average-4", "average-1-cat-pooled", "pooled"]


def embedding(kind: str, layers: Column, pooled: Column, valid: Column) -> Column:
    """The vector of a text from the last layers (arrays of tokens' vectors, last layer last) and the pooled
    output; zeros for an invalid text."""
    if kind not in POOLINGS:
        raise ValueError(f"no pooling {kind}")
    last = lambda k: F.element_at(layers, -k)
    if kind == "pooled":
        out = pooled
    elif kind == "average-1-cat-pooled":
        out = F.concat(_mean(last(1)), pooled)
    else:
        _, *how, k = kind.split("-")
        tokens = last(int(k))
        if how:
            join = _add if how == ["sum"] else _beside
            for i in range(int(k) - 1, 0, -1):
                tokens = join(tokens, last(i))
        out = _mean(tokens)
    return F.when(valid, out).otherwise(F.transform(out, lambda _: F.lit(0.0)))
