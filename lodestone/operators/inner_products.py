"""Largest inner products by an index of cells.

A further dimension, sqrt(M^2 - |x|^2) with M the longest length, makes the row of the largest inner product the
nearest one.  Rows are dealt into cells around means of a sample; a query is compared with the rows of the cells
that are nearest to it, by a join on the cell.  What the other cells could hold at most follows from their radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import written

#: Rows that the means are made of, at most so many cells, rows and queries of a cell that one task holds together.
SAMPLE, CELLS, BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024, 8192, 1024
#: Share of the sample's neighbours that the probed cells hold.
PROBED_SHARE = 0.97
_ROUNDS = 12


@dataclass
class Index:
    """means: of the cells, with the further dimension; rows: cell, block, id, vector; cells: cell, n, blocks, radius."""

    means: np.ndarray
    rows: DataFrame
    cells: DataFrame
    probes: int


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(rows: DataFrame) -> DataFrame:
    whole = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null").where(whole)


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, longest**2 - (x * x).sum(axis=1)))[:, None]])


def _order(q: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The cells, nearest first, of each query (its further dimension is 0)."""
    return np.argsort(-(q @ means[:, :-1].T - (means * means).sum(axis=1) / 2), axis=1, kind="stable")


def _nearest_mean(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.argmax(x @ means.T - (means * means).sum(axis=1) / 2, axis=1)


def _means(x: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from evenly drawn rows; a mean without rows stays where it was."""
    means = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(_ROUNDS):
        near = _nearest_mean(x, means)
        n = np.bincount(near, minlength=cells)
        sums = np.stack([np.bincount(near, c, cells) for c in x.T], axis=1)
        means[n > 0] = sums[n > 0] / n[n > 0, None]
    return means


def _probes(x: np.ndarray, raw: np.ndarray, means: np.ndarray, k: int) -> int:
    """How many cells hold the share of the sample's own neighbours, for a part of it as queries."""
    queries = np.arange(0, len(raw), max(1, len(raw) // 200))
    order = _order(raw[queries], means)
    place = np.argsort(order, axis=1)
    products = raw[queries] @ raw.T
    products[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-products, axis=1)[:, :k]
    at = place[np.arange(len(queries))[:, None], _nearest_mean(x, means)[best]]
    return int(np.quantile(at, PROBED_SHARE)) + 1


def _dealt(means: np.ndarray, longest: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("vector"))
                cell = _nearest_mean(_lengthened(x, longest), means)
                away = np.sqrt(((x - means[cell, :-1]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(away)], ["id", "vector", "cell", "away"])

    return rows


def build(library: DataFrame, k: int = 10, cells: int | None = None) -> Index:
    """The index of library (id, vector array<double>); rows with a null id or vector, or a vector with null or non-finite
    components, take no part.

    The means and the number of probes for k neighbours come from at most SAMPLE rows, the first by a hash of id;
    every row is in a cell, and a large cell is several blocks.
    """
    rows = _usable(library)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, longest = rows.agg(F.count("*"), F.sqrt(F.max(squares))).first()
    if not n:
        raise ValueError("the library has no rows")
    raw = _vectors(sample["vector"].combine_chunks())
    x = _lengthened(raw, longest)
    cells = min(len(x), CELLS, cells or max(1, int(np.sqrt(n))))
    means = _means(x, cells)
    kind = library.schema["id"].dataType.simpleString()
    dealt = written(rows.mapInArrow(_dealt(means, longest), f"id {kind}, vector array<double>, cell int, away double"), "cells-dealt")
    sizes = written(dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")), "cells")
    # A row a cell, of at most CELLS.
    placed = dealt.join(F.broadcast(sizes.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return Index(means, placed.select("cell", "block", "id", "vector"), sizes, min(cells, _probes(x, raw, means, k)) if len(x) > 1 else 1)


def _probed(means: np.ndarray, first: int, last: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _order(_vectors(batch.column("vector")), means)[:, first:last]
                at = np.repeat(np.arange(batch.num_rows), cells.shape[1])
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("vector"), pa.array(cells.ravel().astype(np.int32))], ["query_id", "vector", "cell"])

    return rows


def _bounded(means: np.ndarray, radius: np.ndarray, first: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells from the first on whose rows could be as good as the limit."""
        for batch in batches:
            if batch.num_rows:
                q = _vectors(batch.column("vector"))
                most = q @ means[:, :-1].T + np.sqrt((q * q).sum(axis=1))[:, None] * radius
                limit = batch.column("limit").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                open_ = most >= limit[:, None] - 1e-6
                np.put_along_axis(open_, _order(q, means)[:, :first], False, axis=1)
                at, cell = np.nonzero(open_)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("vector"), pa.array(cell.astype(np.int32))], ["query_id", "vector", "cell"])

    return rows


def _compared(k: int, digits: int):
    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of a block for each query that probes it, and all that tie with the last of them."""
        schema = pa.schema([("query_id", left.schema.field("query_id").type), ("id", right.schema.field("id").type), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        scores = np.round(_vectors(left["vector"].combine_chunks()) @ _vectors(right["vector"].combine_chunks()).T, digits)
        take = min(k, scores.shape[1])
        limit = -np.partition(-scores, take - 1, axis=1)[:, take - 1 : take]
        i, m = np.nonzero(scores >= limit)
        return pa.Table.from_arrays([left["query_id"].take(pa.array(i)), right["id"].take(pa.array(m)), pa.array(scores[i, m])], schema=schema)

    return rows


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(index: Index, asked: DataFrame, k: int, digits: int) -> DataFrame:
    """The best rows of the cells that queries ask: a cell's blocks meet its queries, so many of them together."""
    n = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    # A row a cell, of at most CELLS.
    n = F.broadcast(n.join(F.broadcast(index.cells.select("cell", "blocks")), "cell"))
    queries = asked.join(n, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = index.rows.join(n.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["cell", "block", "part"]
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {index.rows.schema['id'].dataType.simpleString()}, score double"
    return queries.select(*keys, "query_id", "vector").groupBy(*keys).cogroup(rows.select(*keys, "id", "vector").groupBy(*keys)).applyInArrow(_compared(k, digits), kinds)


def search(index: Index, queries: DataFrame, k: int, exact: bool = False, digits: int = 9) -> DataFrame:
    """query_id, rank from 1, id and score (the inner product, rounded to digits) of the k best rows found for each of
    queries (id, vector); ties go to the smaller id.  Queries that build would leave out have no rows.

    A query that finds fewer than k rows in the probed cells, and with exact every one, is also compared with the
    rows of all cells that can hold one as good as its k-th, so its rows are those of a scan.
    """
    queries = _usable(queries).withColumnRenamed("id", "query_id")
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vector array<double>, cell int"
    first = written(_met(index, queries.mapInArrow(_probed(index.means, 0, index.probes), kind), k, digits), "cells-found")
    # The k-th score of each query, null if there are fewer.
    limits = _best(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("limit"))
    radius = np.full(len(index.means), -np.inf)
    for r in index.cells.select("cell", "radius").collect():
        radius[r["cell"]] = r["radius"]
    more = queries.join(limits, "query_id", "left")
    more = more if exact else more.where(F.col("limit").isNull())
    second = _met(index, more.mapInArrow(_bounded(index.means, radius, index.probes), kind), k, digits)
    return _best(first.union(second), k).select("query_id", "rank", "id", "score")


def rows_read(index: Index, queries: DataFrame) -> float:
    """The mean share of the library's rows that a query's probed cells hold."""
    asked = _usable(queries).withColumnRenamed("id", "query_id")
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vector array<double>, cell int"
    probed = asked.mapInArrow(_probed(index.means, 0, index.probes), kind).join(F.broadcast(index.cells), "cell")
    each = probed.groupBy("query_id").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0]
    return (each or 0.0) / index.cells.agg(F.sum("n")).first()[0]
