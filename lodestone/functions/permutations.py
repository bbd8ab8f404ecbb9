"""Permutation language models: masked spans, a random order of factorisation, and who may see whom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import chance


def _drawn(key: Column, i: Column | int, seed: int, what: int) -> Column:
    return chance(F.pmod(key * 4096 + i, F.lit(1 << 31)), seed + what)


def spans(n: Column, key: Column, seed: int = 0, longest: int = 5, share: float = 1 / 6) -> Column:
    """start and size of the spans of a row of n tokens: each of 1 to longest tokens, at a random place of a context of
    size / share tokens; contexts follow each other until the row ends."""
    most = F.floor(n / int(1 / share)) + 1
    start = F.struct(F.lit(0).cast("bigint").alias("cur"), F.array().cast("array<struct<start: bigint, size: bigint>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        size = F.floor(_drawn(key, k, seed, 1) * longest) + 1
        context = F.floor(size / share + 1e-9)
        at = acc["cur"] + F.floor(_drawn(key, k, seed, 2) * (context - size + 1))
        more = F.struct((acc["cur"] + context).alias("cur"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), size.alias("size")))).alias("out"))
        return F.when(acc["cur"] < n, more).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), most), start, step, lambda acc: acc["out"])


def order(n: Column, key: Column, seed: int = 0) -> Column:
    """The place of each of n tokens, an even number, in a random order in which both halves are permuted alike and
    none of the first comes after one of the second."""
    half = (n / 2).cast("int")
    shuffled = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), half - 1), lambda t: F.struct(_drawn(key, t, seed, 3).alias("by"), t.alias("t")))), lambda x: x["t"])
    return F.when(half > 0, F.concat(shuffled, F.transform(shuffled, lambda t: t + half))).otherwise(F.array().cast("array<int>"))


def permuted(ids: Column, key: Column, mask_id: int, specials: list[int], seed: int = 0, longest: int = 5, share: float = 1 / 6, ignore: int = -100) -> Column:
    """inputs, labels, masked and places of a row of ids, as a struct; an odd number of ids is an error.

    Tokens of the spans but specials (padding among them) are masked; places is the order, -1 for a token that all see:
    one that is neither masked nor special.  Chances come from hashes of key * 4096 + place.
    """
    n = F.size(ids)
    found = spans(n, key, seed, longest, share)
    # A lambda binds the spans once for all places.
    inside = F.transform(F.array(found), lambda s: F.transform(ids, lambda x, i: ~x.isin(specials) & F.exists(s, lambda p: (i >= p["start"]) & (i < p["start"] + p["size"]))))[0]

    def built(m: Column) -> Column:
        inputs = F.zip_with(ids, m, lambda x, y: F.when(y, F.lit(mask_id)).otherwise(x))
        labels = F.zip_with(ids, m, lambda x, y: F.when(y, x).otherwise(F.lit(ignore)))
        places = F.zip_with(F.zip_with(order(n, key, seed), m, lambda p, y: F.struct(p.alias("p"), y.alias("y"))), ids, lambda z, x: F.when(~z["y"] & ~x.isin(specials), F.lit(-1)).otherwise(z["p"]))
        return F.struct(inputs.alias("inputs"), labels.alias("labels"), m.alias("masked"), places.alias("places"))

    rows = F.transform(F.array(inside), built)[0]
    even = F.when(n % 2 == 0, F.lit(True)).otherwise(F.raise_error(F.lit("the number of tokens must be even")).cast("boolean"))
    return F.when(even, rows)


def permutation_mask(places: Column, masked: Column) -> Column:
    """Of each token i and each token j, 1 if i may not see j: j is masked and i isn't after it in the order."""
    return F.transform(places, lambda p: F.zip_with(places, masked, lambda q, m: ((p <= q) & m).cast("int")))
