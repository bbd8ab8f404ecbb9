"""Splits, caps, samples and folds by a portable hash: the same rows fall the same way everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import chance, portable_hash

PRIORITY = {"high_priority": {"train": 0, "val": 1, "test": 2}, "low_priority": {"test": 0, "val": 1, "train": 2}}


def split_of(key: Column, train: float = 0.6, val: float = 0.5, seed: int = 1) -> Column:
    """train, val or test; val is its share of what train leaves."""
    u = chance(key, seed)
    return F.when(u < train, "train").when(u < train + (1 - train) * val, "val").otherwise("test")


def without_overlap(rows: DataFrame, item: str, split: str = "split", method: str = "high_priority") -> DataFrame:
    """No item stands in two splits: all its rows go to the split of the highest priority it is in."""
    order = PRIORITY[method]
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    best = rows.groupBy(item).agg(F.min(rank[F.col(split)]).alias("_best"))
    back = F.create_map(*[F.lit(x) for k, v in order.items() for x in (v, k)])
    return rows.join(best, item).withColumn(split, back[F.col("_best")]).drop("_best")


def capped(rows: DataFrame, split: str, key: str, most: dict[str, int], seed: int = 1) -> DataFrame:
    """At most so many rows of each split, the first by hash: a bounded top-k for each capped split; rows of the others
    are left alone."""
    out = rows.where(F.col(split).isNull() | ~F.col(split).isin(list(most)))
    for name, n in most.items():
        out = out.unionByName(rows.where(F.col(split) == name).orderBy(portable_hash(F.col(key), seed), key).limit(n))
    return out


def shuffled(rows: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """rows with their place in a seeded shuffle, from 0."""
    from .sequences import numbered

    return numbered(rows.withColumn("_h", portable_hash(F.col(key), seed)), ["_h", key], "place").drop("_h")


def folds(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    return rows.withColumn("fold", F.pmod(portable_hash(F.col(key), seed), F.lit(n)).cast("int"))


def negatives(rows: DataFrame, nth: str, value: str, seed: int = 1) -> DataFrame:
    """Each row with another row's value, drawn by hash; rows are numbered from 0 by nth without gaps."""
    n = rows.count()
    if n < 2:
        return rows.withColumn("other", F.lit(None).cast(rows.schema[value].dataType))
    at = F.pmod(F.col(nth) + 1 + F.pmod(portable_hash(F.col(nth), seed), F.lit(n - 1)), F.lit(n))
    other = rows.select(F.col(nth).alias("_at"), F.col(value).alias("other"))
    return rows.withColumn("_at", at).join(other, "_at").drop("_at")


def shards(rows: DataFrame, nth: str, n: int) -> DataFrame:
    """Contiguous shards of equal size; the first rows come again at the end to fill the last one."""
    total = rows.count()
    size = -(-total // n) if total else 0
    again = rows.where(F.col(nth) < n * size - total).withColumn(nth, F.col(nth) + total)
    return rows.unionByName(again).withColumn("shard", F.floor(F.col(nth) / max(size, 1)).cast("int"))
