"""Learning-rate multipliers as functions of the step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _warm(step: Column, warmup: int, then: Column) -> Column:
    return F.when(step < warmup, step / max(1, warmup)).otherwise(then)


def _progress(step: Column, warmup: int, total: int) -> Column:
    return (step - warmup) / max(1, total - warmup)


def constant(step: Column, warmup: int = 0) -> Column:
    return _warm(step, warmup, F.lit(1.0))


def linear(step: Column, warmup: int, total: int) -> Column:
    return _warm(step, warmup, F.greatest(F.lit(0.0), (total - step) / max(1, total - warmup)))


def cosine(step: Column, warmup: int, total: int, cycles: float = 0.5) -> Column:
    return _warm(step, warmup, F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(2 * math.pi * cycles * _progress(step, warmup, total)))))


def hard_restarts(step: Column, warmup: int, total: int, cycles: int = 1) -> Column:
    p = _progress(step, warmup, total)
    return _warm(step, warmup, F.when(p >= 1, 0.0).otherwise(0.5 * (1 + F.cos(math.pi * ((cycles * p) % 1.0)))))


def polynomial(step: Column, warmup: int, total: int, start: float, end: float, power: float = 1.0) -> Column:
    left = 1 - _progress(step, warmup, total)
    return _warm(step, warmup, F.when(step > total, end / start).otherwise(((start - end) * F.pow(left, F.lit(power)) + end) / start))
