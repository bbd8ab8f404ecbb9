"""Label sets of fingerprints and the entries nearest to a prediction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Queries go to all rows of the library in broadcast blocks of so many bytes; their scores are made in
#: pieces of so many.
BLOCK_BYTES, SCORES_BYTES = 64 << 20, 32 << 20


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def label_set(sources: list[DataFrame], fp: str, order: str) -> DataFrame:
    """Union of sources without repeated fingerprints: an entry of an earlier source wins over one
    of a later, and within a source the last in order."""
    tagged = None
    for i, s in enumerate(sources):
        part = s.withColumn("_rank", F.struct(F.lit(-i), F.col(order)))
        tagged = part if tagged is None else tagged.unionByName(part)
    return keep_last(tagged, fp, "_rank").drop("_rank")


def _pieces(n: int, rows: int) -> Iterator[slice]:
    """Slices of n queries whose scores with so many rows take SCORES_BYTES at most."""
    step = max(1, SCORES_BYTES // (8 * max(rows, 1)))
    return (slice(i, i + step) for i in range(0, n, step))


def _query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The queries (id and columns of vectors) in blocks of BLOCK_BYTES, never all of them at once."""
    first = queries.first()
    if first is None:
        return
    row_bytes = 8 * (1 + sum(len(first[c]) for c in columns))
    blocks = max(1, -(-queries.count() * row_bytes // BLOCK_BYTES))
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", *columns).toArrow()
        if len(part):
            vectors = (part[c].combine_chunks().flatten().to_numpy().reshape(len(part), -1) for c in columns)
            yield (part["id"].to_numpy(), *vectors)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-6)


def _scored(queries, k: int, measure: str, exclude_self: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = queries.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(own), -1)
            for piece in _pieces(len(ids), len(own)):
                q, v = ids[piece], vectors[piece]
                near = _unit(v) @ _unit(x).T if measure == "cosine" else v @ x.T
                if exclude_self:
                    near[q[:, None] == own[None, :]] = -np.inf
                take = min(k, near.shape[1])
                # All that tie with the k-th stay, the window below decides.
                limit = -np.partition(-near, take - 1, axis=1)[:, take - 1 : take]
                i, m = np.nonzero((near >= limit) & np.isfinite(near))
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(own[m]), pa.array(near[i, m])], ["query_id", "match_id", "similarity"])

    return rows


def top_k(queries: DataFrame, library: DataFrame, k: int, measure: str = "cosine", digits: int | None = None, exclude_self: bool = False, ignore_duplicates: bool = False, project=None) -> DataFrame:
    """query_id, rank from 1, match_id and similarity of the k most similar rows of library.

    Both have (id, vector array<double>) of one length, without nulls; ids of queries and of library are
    unrelated, unless exclude_self leaves out the row of a query's own id.  Similarity is the cosine or
    the inner product; ties go to the smaller id.  k above the number of rows is an error.  With digits,
    similarities are rounded before they are ranked; with ignore_duplicates, of equal vectors the one
    of the smallest id counts; project maps (id, vector) to (id, components), which are added.

    The queries are a stated set, broadcast in blocks of bounded bytes; the library is scanned once a block and
    never shuffled, only the k best of each task are.
    """
    spark = queries.sparkSession
    if ignore_duplicates:
        library = library.groupBy("vector").agg(F.min("id").alias("id"))
    if library.limit(k).count() < k:
        raise ValueError(f"the label set has fewer than {k} entries")
    found = None
    for block in _query_blocks(queries, ["vector"]):
        shared = spark.sparkContext.broadcast(block)
        near = library.select("id", "vector").mapInArrow(_scored(shared, k, measure, exclude_self), "query_id bigint, match_id bigint, similarity double")
        found = near if found is None else found.union(near)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, match_id bigint, similarity double")
    if digits is not None:
        found = found.withColumn("similarity", F.round("similarity", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "match_id", "similarity")
    if project is not None:
        best = best.join(project(library).withColumnRenamed("id", "match_id"), "match_id").select("query_id", "rank", "match_id", "similarity", "components")
    return best


def _similarities(block: tuple[np.ndarray, ...], batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, similarity to each row of the batch, and to the own target, in pieces."""
    ids, preds, targets = block
    x = _unit(batch.column(0).flatten().to_numpy().reshape(len(batch), -1))
    for piece in _pieces(len(ids), len(batch)):
        p, t = _unit(preds[piece]), _unit(targets[piece])
        yield ids[piece], p @ x.T, np.einsum("qd,qd->q", p, t)


def _nearest_to_target(queries):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, near, wanted in _similarities(queries.value, batch):
                at = np.abs(near - wanted[:, None]).argmin(axis=1)
                best = near[np.arange(len(ids)), at]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.abs(best - wanted)), pa.array(best)], ["query_id", "off", "similarity"])

    return rows


def _better(queries, snapped):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, near, _ in _similarities(queries.value, batch):
                limit = np.array([snapped.value[i] for i in ids.tolist()])
                # Equal vectors differ in the last few bits.
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near > limit[:, None] + 1e-12).sum(axis=1))], ["query_id", "better"])

    return rows


def target_ranks(predictions: DataFrame, library: DataFrame, ignore_duplicates: bool = False) -> DataFrame:
    """query_id and how many rows of library (vector) are strictly nearer to the prediction than its target.

    The target's distance is first snapped to that of the row whose distance is nearest to it (of two as
    near, the more similar row's), so a target that the library doesn't hold counts as its stand-in.  Ties
    don't count against it.  predictions has (id, vector, target), is a stated set and goes in blocks; each
    block takes two scans of the library.  With ignore_duplicates, equal vectors count once.
    """
    spark = predictions.sparkSession
    library = library.select("vector").distinct() if ignore_duplicates else library.select("vector")
    found = None
    for block in _query_blocks(predictions, ["vector", "target"]):
        shared = spark.sparkContext.broadcast(block)
        close = library.mapInArrow(_nearest_to_target(shared), "query_id bigint, off double, similarity double")
        # One row for each query of the block.
        snapped = close.groupBy("query_id").agg(F.min_by("similarity", F.struct("off", -F.col("similarity"))).alias("similarity")).toArrow()
        limits = spark.sparkContext.broadcast(dict(zip(snapped["query_id"].to_pylist(), snapped["similarity"].to_pylist(), strict=True)))
        near = library.mapInArrow(_better(shared, limits), "query_id bigint, better bigint")
        found = near if found is None else found.union(near)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, better bigint")
    return found.groupBy("query_id").agg(F.sum("better").alias("rank"))


def top_k_accuracy(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """k and the share of queries whose target is among the k nearest."""
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    return ranks.select("rank", k).groupBy("k").agg(F.avg((F.col("rank") < F.col("k")).cast("double")).alias("accuracy"))


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Elementwise mean over the rows of a key, as (keys, vector): vectors are added up as they are, in each part first."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.groupBy(*keys).agg(mean.alias("_mean")).select(*keys, vector_to_array("_mean").alias(vector))


def with_cached(rows: DataFrame, cache: DataFrame, key: str, value: str, compute) -> DataFrame:
    """rows with value looked up in cache by key; for keys that miss, compute(DataFrame of keys) gives (key, value)."""
    hit = rows.join(cache, key, "left")
    missing = rows.select(key).distinct().join(cache, key, "left_anti")
    made = compute(missing).select(key, F.col(value).alias("_made"))
    return hit.join(made, key, "left").withColumn(value, F.coalesce(value, "_made")).drop("_made")


def cosine_loss(a: Column, b: Column) -> Column:
    from ..functions.vectors import cosine

    return 1 - cosine(a, b)


def folded(sparse: DataFrame, key: str, size: int) -> DataFrame:
    """key, counts and bits (arrays of size) of a sparse fingerprint (key, index, n): places are index modulo size;
    counts add up, bits are 1."""
    places = sparse.groupBy(key, F.pmod(F.col("index"), F.lit(size)).cast("int").alias("place")).agg(F.sum("n").alias("n"))
    rows = places.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(size - 1))
    counts = F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return rows.select(key, counts.alias("counts"), F.transform(counts, lambda n: (n > 0).cast("bigint")).alias("bits"))


def labels_of(rows: DataFrame, label: str, known: list[str]) -> DataFrame:
    """labels: the sorted union of known labels and those of the rows."""
    return rows.agg(F.array_sort(F.array_distinct(F.concat(F.collect_set(label), F.array(*map(F.lit, known))))).alias("labels"))
