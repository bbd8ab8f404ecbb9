"""Distribution functions against sums and integrals; permutation masks against a plain twin."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import permutations, statistics, tokens


def integral(density, a, b, n=4000):
    """Gauss-Legendre with five points a piece."""
    points = [(0.0, 128 / 225), *[(s * math.sqrt(5 - 2 * math.sqrt(10 / 7)) / 3, (322 + 13 * math.sqrt(70)) / 900) for s in (-1, 1)], *[(s * math.sqrt(5 + 2 * math.sqrt(10 / 7)) / 3, (322 - 13 * math.sqrt(70)) / 900) for s in (-1, 1)]]
    h = (b - a) / n
    return sum(w * density(a + h * (i + 0.5 + p / 2)) for i in range(n) for p, w in points) * h / 2


def values(spark, name, params, xs):
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", statistics.cdf(name, F.col("x"), params).alias("y"))
    return {r.x: r.y for r in rows.collect()}


@pytest.mark.parametrize("a", [0.7, 2.5, 30.0, 400.0])
def test_incomplete_gamma(spark, a):
    got = values(spark, "gamma", [a, 0.0, 1.0], [a * f for f in (0.3, 0.8, 0.999, 1.0, 1.001, 1.2, 2)] + [-1.0, 0.0, a + 1])
    for x, y in got.items():
        # Written in t ** a, or in the root of t, the density is smooth at 0.
        if a < 1:
            want = integral(lambda u: math.exp(-(u ** (1 / a)) - math.lgamma(a + 1)), 0, max(x, 0) ** a)
        else:
            want = integral(lambda u: 2 * math.exp((2 * a - 1) * math.log(u) - u * u - math.lgamma(a)), 0, math.sqrt(max(x, 0))) if x > 0 else 0.0
        assert abs(y - want) < 1e-10, (a, x)


@pytest.mark.parametrize(("a", "b"), [(1.0, 1.0), (2.5, 7.25), (40.0, 3.0), (300.0, 250.0)])
def test_incomplete_beta(spark, a, b):
    got = values(spark, "beta", [a, b, 0.0, 1.0], [-0.5, 0.0, 0.01, 0.2, 0.25, 0.5, 0.54, 0.6, 0.9, 0.99, 1.0, 1.5])
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    for x, y in got.items():
        want = min(1.0, max(0.0, x)) if x <= 0 or x >= 1 else integral(lambda t: math.exp(front + (a - 1) * math.log(t) + (b - 1) * math.log(1 - t)), 0, x)
        assert abs(y - want) < 1e-10, (a, b, x)


def test_families_that_follow(spark):
    xs = [0.1, 0.5, 1.0, 2.0, 7.5]
    assert all(abs(y - (0.5 + math.atan(x) / math.pi)) < 1e-11 for x, y in values(spark, "t", [1.0, 0.0, 1.0], [-3.0, *xs]).items())
    assert all(abs(y - math.erf(math.sqrt(x / 2))) < 1e-11 for x, y in values(spark, "chi2", [1.0, 0.0, 1.0], xs).items())
    assert all(abs(y - x / (1 + x)) < 1e-11 for x, y in values(spark, "f", [2.0, 2.0, 0.0, 1.0], xs).items())
    assert all(abs(y - 0.5 * (1 + math.erf(math.log(x) / math.sqrt(2) / 0.7))) < 1e-11 for x, y in values(spark, "lognorm", [0.7, 0.0, 1.0], xs).items())
    assert all(abs(y - math.exp(-1 / x)) < 1e-11 for x, y in values(spark, "invgamma", [1.0, 0.0, 1.0], xs).items())
    assert all(abs(y - (x / (1 + x)) ** 2) < 1e-11 for x, y in values(spark, "betaprime", [2.0, 1.0, 0.0, 1.0], xs).items())
    assert all(abs(y - math.erf(x / math.sqrt(2))) < 1e-11 for x, y in values(spark, "halfnorm", [0.0, 1.0], xs).items())
    with pytest.raises(ValueError, match="no distribution"):
        values(spark, "none", [0.0, 1.0], xs)


def test_incomplete_functions_of_many_values(spark):
    rows = spark.range(400_000).select((F.col("id") / 20_000).alias("x"))
    started = time.monotonic()
    got = rows.select(*[F.avg(statistics.cdf(n, F.col("x"), p)).alias(n) for n, p in (("gamma", [2.0, 0.0, 1.0]), ("beta", [2.0, 1.0, 0.0, 20.0]), ("invgamma", [1.0, 0.0, 1.0]))]).first()
    assert time.monotonic() - started < 40
    assert abs(got.gamma - (18 + 22 * math.exp(-20)) / 20) < 1e-4 and abs(got.beta - 1 / 3) < 1e-4
    odd = values(spark, "gamma", [2.0, 0.0, 1.0], [math.inf, -math.inf])
    assert odd == {math.inf: 1.0, -math.inf: 0.0}


def chance(key, seed):
    first = ((key + seed) * tokens.MULTIPLIER) % tokens.MODULUS
    return ((first >> 7) * (2246822519 % (1 << 31)) + first) % tokens.MODULUS / tokens.MODULUS


def plain_permutation(ids, key, seed, longest, share, specials):
    draw = lambda i, what: chance((key * 4096 + i) % (1 << 31), seed + what)
    n, cur, k, masked = len(ids), 0, 0, [False] * len(ids)
    while cur < n:
        size = int(draw(k, 1) * longest) + 1
        context = int(size / share + 1e-9)
        start = cur + int(draw(k, 2) * (context - size + 1))
        for i in range(start, min(n, start + size)):
            masked[i] = True
        cur, k = cur + context, k + 1
    masked = [m and x not in specials for m, x in zip(masked, ids, strict=True)]
    perm = sorted(range(n // 2), key=lambda t: (draw(t, 3), t))
    places = [p for p in perm] + [p + n // 2 for p in perm]
    places = [-1 if not m and x not in specials else p for p, m, x in zip(places, masked, ids, strict=True)]
    mask = [[int(places[i] <= places[j] and masked[j]) for j in range(n)] for i in range(n)]
    return masked, places, mask


def test_permutations(spark):
    rng = random.Random(1)
    rows = [(k * 7919, [1] + [rng.randrange(5, 100) for _ in range(2 * rng.randrange(1, 25))] + [2]) for k in range(40)] + [(3, [])]
    frame = spark.createDataFrame(rows, "key long, ids array<int>").select("key", "ids", permutations.permuted(F.col("ids"), F.col("key"), 4, [1, 2], 9).alias("p"))
    seen = 0
    for r in frame.select("key", "ids", "p.*", permutations.permutation_mask(F.col("p.places"), F.col("p.masked")).alias("mask")).collect():
        masked, places, mask = plain_permutation(r.ids, r.key, 9, 5, 1 / 6, {1, 2})
        assert (r.masked, r.places, r.mask) == (masked, places, mask)
        assert r.inputs == [4 if m else x for m, x in zip(masked, r.ids, strict=True)] and r.labels == [x if m else -100 for m, x in zip(masked, r.ids, strict=True)]
        seen += sum(masked)
    assert seen > 100
    with pytest.raises(Exception, match="must be even"):
        spark.createDataFrame([(1, [1, 2, 3])], "key long, ids array<int>").select(permutations.permuted(F.col("ids"), F.col("key"), 4, [1])).collect()
