"""Clusters of sets of bits around those with the most neighbours (Butina)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .sequences import running

#: Sets in a block, and cells of a matrix of sets and bits.
BLOCK, DENSE = 1024, 1 << 24


def tanimoto(a: Column, b: Column) -> Column:
    """Elements in both over elements in either, of arrays without repeats; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: the ids whose bits have a Tanimoto similarity of least (above 0) or more.

    sets has id and bits (an array without repeats).  Two sets that are so similar share one of the rarest bits of
    each: of n bits, the first n - least * n + 1 by how many sets hold them.  Only sets that meet there are
    compared, block by block, and nothing but similar pairs leaves a task.
    """
    slack = 1e-9
    each = sets.select("id", F.size("bits").alias("n"), F.explode("bits").alias("bit"))
    held = each.groupBy("bit").agg(F.count("*").alias("held"))
    ordered = each.join(held, "bit").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "bit"))).alias("bits"))
    kept = F.col("n") - F.ceil(F.col("n") * (least - slack)) + 1
    prefix = ordered.select("id", "n", F.explode(F.slice("bits", F.lit(1), kept.cast("int"))).alias("x")).select("id", "n", "x.bit")
    prefix = written(prefix, "similar-prefixes")
    # The sets that hold a bit are dealt into blocks; each two blocks, and each with itself, are compared at once.
    most = prefix.groupBy("bit").agg(F.count("*").alias("m")).where("m > 1").select("bit", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = prefix.join(most, "bit").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = own.select("id", "bit", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = sets.schema["id"].dataType.simpleString()
    named = sets.select("id", F.transform(F.array_distinct("bits"), lambda x: F.xxhash64(x)).alias("marks"))
    met = pair.join(named, "id").groupBy("bit", "i", "j").applyInArrow(_similar(least), f"a {kind}, b {kind}").distinct()
    met = met.join(sets.select(F.col("id").alias("a"), F.col("bits").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("bits").alias("right")), "b")
    # The marks of bits are hashes; the bits decide.
    return met.where(1 - tanimoto(F.col("left"), F.col("right")) <= 1 - least).select("a", "b")


def _similar(least: float):
    def pairs(table: pa.Table) -> pa.Table:
        """Of two blocks: counts of marks in both are a product of their matrices, some rows of them at a time."""
        ids, own, marks = table.column("id").combine_chunks(), table.column("own").to_numpy(), table.column("marks").combine_chunks()
        n = marks.value_lengths().to_numpy(zero_copy_only=False)
        names, at = np.unique(marks.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        held = np.zeros((len(ids), len(names)), np.float32) if len(ids) * len(names) <= DENSE else None
        rows = np.repeat(np.arange(len(ids)), n)
        if held is not None:
            held[rows, at] = 1
        first, second = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        left, right = [], []
        for begin in range(0, len(first), 256):
            x = first[begin : begin + 256]
            if held is not None:
                both = held[x] @ held[second].T
            else:
                both = _counted(x, second, n, at)
            either = n[x][:, None] + n[second][None, :] - both
            i, j = np.nonzero(1 - both.astype(np.float64) / np.maximum(either, 1) <= 1 - least + 1e-9)
            left.append(x[i])
            right.append(second[j])
        left, right = (ids.take(pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))) for v in (left, right))
        good = pc.less(left, right) if own.min() == own.max() else pa.array(np.ones(len(left), bool))
        left, right = left.filter(good), right.filter(good)
        swap = pc.less(right, left)
        return pa.table({"a": pc.if_else(swap, right, left), "b": pc.if_else(swap, left, right)})

    return pairs


def _counted(x: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks in both of the rows x and y, where a matrix of all marks would be too large: only those of x have columns."""
    begin = np.cumsum(n) - n
    take = lambda z: (np.repeat(begin[z] - np.cumsum(n[z]) + n[z], n[z]) + np.arange(n[z].sum()), np.repeat(np.arange(len(z)), n[z]))
    places, row = take(x)
    names, mine = np.unique(at[places], return_inverse=True)
    out = np.zeros((len(x), len(y)), np.float32)
    others, other_row = take(y)
    found = np.minimum(np.searchsorted(names, at[others]), len(names) - 1)
    hit = names[found] == at[others] if len(names) else np.zeros(len(others), bool)
    for c in range(0, len(names), 1024):
        a, b = np.zeros((len(x), 1024), np.float32), np.zeros((len(y), 1024), np.float32)
        of = (mine >= c) & (mine < c + 1024)
        a[row[of], mine[of] - c] = 1
        of = hit & (found >= c) & (found < c + 1024)
        b[other_row[of], found[of] - c] = 1
        out += a @ b.T
    return out


def butina(sets: DataFrame, cutoff: float) -> DataFrame:
    """id, centre and neighbours of each row of sets (id, bits): centre is the id of its cluster's centre.

    Neighbours are other rows at a distance (1 - Tanimoto) of at most cutoff, below 1.  Rows come in order of
    their neighbours, most first, then of their ids; one that isn't in a cluster yet becomes a centre and takes
    those of its neighbours that aren't either.

    Rows with equal bits are one entry with a weight, so copies are never paired.  A row is a centre if no
    neighbour before it is one: in each round, entries with no open neighbour before them become centres and
    close their neighbours, until none is open.  At last each other entry goes to the first of its centres.
    """
    if not 0 <= cutoff < 1:
        raise ValueError("the cutoff must be from 0 to below 1")
    rows = sets.select("id", F.array_sort(F.array_distinct("bits")).alias("bits"))
    entries = written(rows.groupBy("bits").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "butina-entries")
    pairs = written(similar_pairs(entries.select("id", "bits"), 1 - cutoff), "butina-pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("id", "other")
    near = both.join(entries.select(F.col("id").alias("other"), "weight"), "other").groupBy("id").agg(F.sum("weight").alias("near"))
    ranked = entries.join(near, "id", "left").select("id", "weight", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("neighbours"))
    # Places are compared as structs: the largest comes first.
    ranked = written(ranked.withColumn("place", F.struct("neighbours", (-F.col("id")).alias("minus_id"))), "butina-ranked")
    place = ranked.select("id", "place")
    edges = both.join(place, "id").join(place.select(F.col("id").alias("other"), F.col("place").alias("other_place")), "other")
    # Only from an entry to those before it.
    edges = written(edges.where("other_place > place").select("id", F.col("other").alias("before"), F.col("other_place").alias("before_place")), "butina-edges")

    # Entries whose centre is known drop out of the edges that a round reads.
    open_, centres, left = ranked.select("id"), None, edges
    while True:
        found = written(open_.join(left.select("id").distinct(), "id", "left_anti"), "butina-centres")
        centres = found if centres is None else centres.union(found)
        # Those after a new centre, and, for what lies before others, edges of closed entries, are done.
        closed = written(left.join(found.withColumnRenamed("id", "before"), "before", "left_semi").select("id").distinct(), "butina-closed")
        done = found.union(closed)
        open_ = written(open_.join(done, "id", "left_anti"), "butina-open")
        if open_.isEmpty():
            break
        left = written(left.join(closed, "id", "left_anti").join(done.withColumnRenamed("id", "before"), "before", "left_anti").select("id", "before", "before_place"), "butina-left")
    chosen = edges.join(centres.withColumnRenamed("id", "before"), "before", "left_semi").groupBy("id").agg(F.max_by("before", "before_place").alias("first"))
    chosen = ranked.join(chosen, "id", "left").join(centres.select("id", F.lit(True).alias("is_centre")), "id", "left")
    chosen = chosen.select("id", F.when(F.col("is_centre"), F.col("id")).otherwise(F.col("first")).alias("centre"), "neighbours")
    by_bits = entries.join(chosen, "id").select("bits", "centre", "neighbours")
    return rows.join(by_bits, "bits").select("id", "centre", "neighbours")


def cluster_split(rows: DataFrame, clusters: DataFrame, shares: list[float], names: list[str]) -> DataFrame:
    """rows (id, ...) with split: whole clusters go to the first split that isn't full yet, largest clusters first, then by centre."""
    sizes = clusters.groupBy("centre").agg(F.count("*").alias("size"))
    upto = running(sizes.withColumn("minus_size", -F.col("size")), ["minus_size", "centre"], {"upto": "size"})
    n = rows.count()
    before = (F.col("upto") - F.col("size")) / max(n, 1)
    split, at = F.lit(names[-1]), sum(shares[:-1])
    for name, share in zip(reversed(names[:-1]), reversed(shares[:-1]), strict=True):
        split = F.when(before < at - 1e-12, name).otherwise(split)
        at -= share
    return rows.join(clusters.select("id", "centre"), "id").join(upto.select("centre", split.alias("split")), "centre")
