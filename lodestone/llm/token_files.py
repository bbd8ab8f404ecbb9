"""Token ids in Parquet files, written in ascending doc_id order and read back selectively.

A row holds doc_id, the number of its file (part), where its ids begin in that file (at), how many
they are (n_tokens) and the ids.  Ids are dictionary encoded lists (vocabulary indexes packed into
as few bits as the row group needs); doc_id, part, at and n_tokens are sorted or small and delta
encoded.  Row groups and pages are small enough that the column and offset indexes, which the
writer adds, let a reader of a few documents skip almost all pages, and a reader of counts never
touches the ids.  A document's place in the whole corpus is its file's first position, from the
n_tokens columns alone, plus at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import sized, written
from .tokens import WORD, encoder

DOCS_PER_FILE = 4000
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 512
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#at": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _encoded(path: str, kind: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(path, kind), 0

        def batch_of(ids, part, starts, lengths, blobs):
            values = pa.array(np.frombuffer(b"".join(blobs), np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            return pa.RecordBatch.from_arrays([ids, part, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "part", "at", "n_tokens", "ids"])

        for batch in batches:
            first, starts, lengths, blobs, began = 0, [], [], [], at
            for i, text in enumerate(batch.column(2)):
                blobs.append(enc.ids(text.as_py()) + end)
                starts.append(at)
                lengths.append(len(blobs[-1]) // 4)
                at += lengths[-1]
                if at - began > 1 << 20 or i + 1 == len(batch):
                    n = i + 1 - first
                    yield batch_of(batch.column(0).slice(first, n), batch.column(1).slice(first, n), starts, lengths, blobs)
                    first, starts, lengths, blobs, began = i + 1, [], [], [], at

    return rows


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, kind: str = WORD, end_id: int = 2, docs_per_file: int = DOCS_PER_FILE) -> None:
    """Encodes every whole text of docs (doc_id, text) and writes the files under path.

    A null or empty text has end_id alone.  Null doc_ids come first, rows with one doc_id follow each other
    by a hash of their texts and may go on in the next file; further columns are ignored.  An empty
    table writes files without rows.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    files = max(1, -(-docs.count() // docs_per_file))
    ordered = docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text")).repartitionByRange(files, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    placed = ordered.select("doc_id", F.spark_partition_id().alias("part"), "text")
    schema = f"doc_id {id_kind}, part int, at bigint, n_tokens bigint, ids array<int>"
    placed.mapInArrow(_encoded(tokenizer_path, kind, end_id), schema).write.options(**WRITER).parquet(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        values, ends = memoryview(lists.values.to_numpy().view(np.uint8)), (lists.offsets.to_numpy() * 4).tolist()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])


def _in_corpus(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with start: the ids of all documents before it, from the counts (part, n_tokens) of all rows."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = written(counts.groupBy("part").agg(F.sum("n_tokens").alias("held")), "token-files-parts")
    # One row a file.
    parts = held.select(F.col("part").alias("of_part"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(sized(parts, held.count(), 64), rows["part"] == F.col("of_part")).withColumn("start", F.col("base") + F.col("at"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start (ids of all documents before it) and n_tokens of every row, repeated ones and null
    doc_ids too, without reading ids."""
    rows = spark.read.parquet(path).select("doc_id", "part", "at", "n_tokens")
    return _in_corpus(rows, rows).select("doc_id", "part", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """doc_id, part, at, n_tokens and ids of the documents from first_id to last_id (all by default);
    the bounds reach the scan, where row groups and pages outside them are skipped.  With a bound, null
    doc_ids are left out; repeated rows are all returned."""
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    rows = read_tokens(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "part", "at", "n_tokens", "ids").mapInArrow(_crc, f"doc_id {kind}, part int, at bigint, n_tokens bigint, ids_crc32 bigint")
    return _in_corpus(rows, read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
