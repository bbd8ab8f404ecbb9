"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  The index is written once, in blocks of
bounded size: the vectors, and for each pivot the inverted file of those that have it among their
nearest, with its rank there.  A query reads the inverted files of its own nearest pivots; the
footrule distance is the sum of rank differences, DEPTH where a pivot is missing.  Vectors within a
limit of it are compared exactly.

The limit is one number for all blocks, so a result doesn't depend on where blocks end: the footrule
within which WITHIN of the true neighbours lie, in a bounded sample of the vectors.  Neighbours are
nearer in the whole than in a sample, so recall is rather higher there.  A query with fewer than k
vectors within the limit is compared with all.

Measured against brute force: see README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_BYTES, new_path, written

#: Pivots are this many of SAMPLE vectors, the first in the order of a hash of their ids; a vector
#: nearer than APART to a pivot isn't another one, lest a large cluster takes all of them.
PIVOTS, SAMPLE, APART = 256, 4096, 0.9
DEPTH = 64
#: The limit is set by the neighbours of so many distinct vectors of the sample.
TRIED, WITHIN = 512, 0.98
#: Vectors of an index block at most.
BLOCK = 8192


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (as doubles) of the vectors that take part: not null, not zero, of finite numbers."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select("vec_id", v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def _choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Unit vectors."""
    unit = sample / np.abs(sample).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    chosen = [0]
    for i in range(1, len(unit)):
        if len(chosen) < PIVOTS and (unit[chosen] @ unit[i]).max() < APART:
            chosen.append(i)
    return unit[chosen]


def _nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        near = unit @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :DEPTH].astype(np.int16)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Double precision; rows are scaled by their largest component first, so nothing overflows."""
    a, b = vectors / np.abs(vectors).max(axis=1, keepdims=True), query / np.abs(query).max()
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


class _Files:
    """Inverted files of some vectors: where each pivot's posts begin, the posts' rows and their ranks."""

    def __init__(self, begins: np.ndarray, posts: np.ndarray, ranks: np.ndarray, n: int, depth: int):
        self.begins, self.posts, self.ranks, self.n, self.depth = begins, posts, ranks, n, depth

    @classmethod
    def of(cls, pivots: np.ndarray, n_pivots: int) -> _Files:
        flat, depth = pivots.reshape(-1), pivots.shape[1]
        order = np.argsort(flat, kind="stable")
        begins = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        return cls(begins.astype(np.int32), (order // depth).astype(np.int32), (order % depth).astype(np.int16), len(pivots), depth)

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """DEPTH for each of the query's pivots, less what their posts take off."""
        low, many = self.begins[query], self.begins[query + 1] - self.begins[query]
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        off = self.depth - np.abs(self.ranks[at] - np.repeat(np.arange(len(query), dtype=np.int16), many))
        return self.depth * self.depth - np.bincount(self.posts[at], weights=off, minlength=self.n)


def _limit(sample: np.ndarray, pivots: np.ndarray, k: int) -> float:
    """The footrule within which WITHIN of the k nearest of some of the sample's distinct vectors lie."""
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(5).permutation(len(sample))]
    order = _nearest_pivots(sample, pivots)
    files, found = _Files.of(order, len(pivots)), []
    for i in range(min(TRIED, len(sample))):
        score = cosines(sample, sample[i])
        score[i] = -np.inf
        nearest = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        found.append(files.footrule(order[i])[nearest])
    every = np.concatenate(found)
    return float(np.quantile(every, WITHIN)) if len(every) else float("inf")


_INDEX = ["ids", "vectors", "begins", "posts", "ranks"]


def _index_rows(pivots):
    """A row for each block of vectors: its ids, vectors and inverted files, as little-endian arrays."""

    def row(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        files = _Files.of(_nearest_pivots(vectors, pivots.value), len(pivots.value))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, files.begins, files.posts, files.ranks)], _INDEX)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                if held and held + len(part) > BLOCK:
                    yield row(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors, held = [], [], 0
                ids.append(part.column(0).to_numpy())
                vectors.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))
                held += len(part)
        if held:
            yield row(np.concatenate(ids), np.concatenate(vectors))

    return rows


def _searched(queries, n_pivots: int, width: int, k: int, limit: float):
    depth = min(DEPTH, n_pivots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors, query_pivots = queries.value
        for batch in batches:
            for row in range(len(batch)):
                ids, vectors, begins, posts, ranks = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate((np.int64, np.float64, np.int32, np.int32, np.int16)))
                vectors = vectors.reshape(-1, width)
                files, out = _Files(begins, posts, ranks, len(ids), depth), []
                for query_id, query, near in zip(query_ids.tolist(), query_vectors, query_pivots, strict=True):
                    found = np.flatnonzero(ids != query_id) if limit == float("inf") else np.flatnonzero((files.footrule(near) <= limit) & (ids != query_id))
                    if not len(found):
                        continue
                    score = cosines(vectors[found], query)
                    if len(found) > k:
                        last = -np.partition(-score, k - 1)[k - 1]
                        found, score = found[score >= last], score[score >= last]
                    best = np.lexsort((ids[found], -score))[:k]
                    out += [(query_id, i, s) for i, s in zip(ids[found][best].tolist(), score[best].tolist(), strict=True)]
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return rows


_FOUND = "query_id bigint, vec_id bigint, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(index: DataFrame, asked: DataFrame, pivots: np.ndarray, k: int, limit: float) -> DataFrame:
    """The k best of each query (vec_id, embedding): queries go to all blocks of the index in broadcast
    blocks of bounded bytes, and each block's result is written."""
    spark, width = asked.sparkSession, pivots.shape[1]
    path = new_path(spark, "ann-found")
    blocks = max(1, -(-asked.count() * (8 * width + 2 * DEPTH + 8) // BROADCAST_BYTES))
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        vectors = part["embedding"].combine_chunks().flatten().to_numpy().reshape(len(part), width)
        order = _nearest_pivots(vectors, pivots) if len(part) else np.zeros((0, min(DEPTH, len(pivots))), np.int16)
        queries = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), vectors, order.astype(np.int64)))
        near = _best(index.mapInArrow(_searched(queries, len(pivots), width, k, limit), _FOUND), k)
        near.write.mode("append").parquet(path)
        queries.unpersist()
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score double").parquet(path)


def _nearest_of_width(rows: DataFrame, width: int, is_query, k: int) -> DataFrame:
    rows = rows.where(F.size("embedding") == width).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    spark = rows.sparkSession
    sample = np.array([r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).collect()])
    pivots = _choose_pivots(sample)
    index = written(rows.mapInArrow(_index_rows(spark.sparkContext.broadcast(pivots)), "ids binary, vectors binary, begins binary, posts binary, ranks binary"), "ann-index")
    asked = written(rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    found = _search(index, asked, pivots, k, _limit(sample, pivots, k))
    enough = found.groupBy("query_id").agg(F.count("*").alias("held")).where(F.col("held") >= k)
    few = asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti")
    few = written(few, "ann-few")
    if few.isEmpty():
        return found
    return found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").union(_search(index, few, pivots, k, float("inf")))


def nearest(embeddings: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the k nearest of each query.

    embeddings needs vec_id and embedding; is_query is a condition on vec_id.  Vectors that are
    null, empty, zero or hold a null or non-finite component take no part, nor do those without vec_id.
    Vectors of different lengths have no cosine: those of each length are searched among themselves.  A
    query's own vec_id is no candidate, ties go to the smaller vec_id, of a repeated vec_id the least vector
    asks, and each of its rows is a candidate.  Fewer than k candidates are all returned; further columns are
    ignored; an empty table gives no rows.
    """
    rows = usable(embeddings)
    found = None
    for (width,) in rows.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect():
        part = _nearest_of_width(rows, width, is_query, k)
        found = part if found is None else found.union(part)
    return found if found is not None else embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
