"""Arithmetic of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Cosine similarity; each norm is eps at least."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def softmax(v: Column) -> Column:
    """Shifted by the maximum; an empty array stays empty."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pad(v: Column, size: Column | int, value, left: bool = False) -> Column:
    """Filled up with value to size; longer arrays stay."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), (F.lit(size) if isinstance(size, int) else size) - F.size(v)).cast("int"))
    return F.concat(fill, v) if left else F.concat(v, fill)


def argmax(v: Column) -> Column:
    """Index from 0 of the first greatest."""
    return F.array_position(v, F.array_max(v)) - 1


def bit_or(a: Column, b: Column) -> Column:
    """Union of two 0/1 (or count) vectors as 0/1."""
    return F.zip_with(a, b, lambda x, y: F.when(x + y > 0, 1).otherwise(0))


def erf(x: Column, terms: int = 60) -> Column:
    """The error function by its series where |x| is under 3 (to 12 digits), and 1 less a continued fraction beyond."""
    t = F.abs(x)
    near = F.least(t, F.lit(3.0))
    start = F.struct(near.alias("term"), near.alias("sum"))

    def step(acc: Column, n: Column) -> Column:
        # 2 ** n * x ** (2 n + 1) / (2 n + 1)!!, all positive, with exp(-x * x) in front.
        term = acc["term"] * 2 * near * near / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = 2 / 3.141592653589793**0.5 * F.exp(-near * near) * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["sum"])
    far = F.greatest(t, F.lit(3.0))
    tail = far
    for k in range(40, 0, -1):
        tail = far + (k / 2) / tail
    beyond = 1 - F.exp(-far * far) / (tail * 3.141592653589793**0.5)
    return F.signum(x) * F.when(t < 3, series).otherwise(beyond)


ACTIVATIONS = {
    "linear": lambda x: x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "tanh": F.tanh,
    "sigmoid": sigmoid,
    "silu": lambda x: x * sigmoid(x),
    "mish": lambda x: x * F.tanh(F.log1p(F.exp(x))),
    "gelu": lambda x: 0.5 * x * (1 + erf(x / 2**0.5)),
    "gelu_new": lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * F.pow(x, F.lit(3.0))))),
    "gelu_fast": lambda x: 0.5 * x * (1 + F.tanh(x * 0.7978845608 * (1 + 0.044715 * x * x))),
}
