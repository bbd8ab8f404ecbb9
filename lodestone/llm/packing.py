"""Best-fit packing by minimum bin slack.

The lengths of the pieces are at most seq_len, so their histogram is a table of at most seq_len
rows whatever the corpus: the packing is found on it, and its bins are patterns with a repetition
count.  Each bin takes the longest length left, then bitset subset-sum dynamic programming over the
lengths still available finds the fullest feasible combination, which is removed - as often as the
counts allow, since the same search would find it again.  Pieces then take their places by their
rank within their length, counted in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import arrow_rows, released, written
from .tokens import BYTE_LEVEL, encoder

SEQ_LEN = 2048
#: Rows that one task ranks together.
RANKED_TOGETHER = 2000


def fullest_bin(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room: length -> how many.

    Bit s of the bitset says whether the sum s can be reached.  Longer lengths are tried first, so
    short ones stay for later bins where either would do.
    """
    reach, steps, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for length in sorted(counts, reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0 and not reach & full:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, chunk = left - take, chunk * 2
        if reach & full:
            break
    at, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            found[length] = found.get(length, 0) + take
    return found


def minimum_bin_slack(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how many) with how many bins are filled by each."""
    left, patterns = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest_bin({k: n for k, n in left.items() if n}, seq_len - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        patterns.append((pattern, times))
    return patterns


def _places(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For looking up a place by (length, rank): runs of ranks, sorted, that share a pattern."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for pattern, times in patterns:
        at = 0
        for length in sorted(pattern, reverse=True):
            n, start = pattern[length], used.get(length, 0)
            rows.append((length << 44 | start, n, first, at, start))
            used[length] = start + n * times
            at += n * length
        first += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def _pieces(path: str, seq_len: int, end_id: int, remembered: int | None):
    end = end_id.to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, BYTE_LEVEL, remembered)
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = enc.ids(text.as_py()) + end
                n = len(ids) // 4
                a, b = 0, (n % seq_len or seq_len) if n > seq_len else n
                k = 0
                while a < n:
                    source.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    a, b, k = b, b + seq_len, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return released(rows)


def _assigned(places):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many, first, at, start = places.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            run = np.searchsorted(keys, length << 44 | rank, "right") - 1
            j = rank - start[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[run] + j // many[run]), pa.array(at[run] + j % many[run] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = 0, remembered: int | None = None) -> DataFrame:
    """Places of all documents in sequences of at most seq_len tokens.

    docs needs doc_id and text; further columns are ignored.  A document is its ids and end_id;
    a null or empty text is end_id alone.  Only documents longer than seq_len are cut: the first
    piece takes the remainder.  Repeated rows are packed as often as they come, a null doc_id like
    any other; equal pieces of equal rows are interchangeable.  An empty table gives no rows.  remembered words a
    worker holds at most (see tokens.encoder).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    with arrow_rows(docs.sparkSession, 1000):
        pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, seq_len, end_id, remembered), schema), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = docs.sparkSession.sparkContext.broadcast(_places(minimum_bin_slack(histogram, seq_len)))

    salts = max(1, -(-max(histogram.values(), default=1) // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    bases = bases.select("length", "salt", "base")
    in_group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    # The pieces are dealt by length and salt already, so this join moves the bases only.
    ranked = salted.withColumn("nth", F.row_number().over(in_group)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_assigned(places), schema + ", sequence_id bigint, offset bigint")
