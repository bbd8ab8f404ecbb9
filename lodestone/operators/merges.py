"""Byte-level symbols of words, joined pair by pair in the order of a table of merges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: The merges are broadcast up to so many rows of 128 bytes; beyond, each word gets those of its own texts by a join.
BROADCAST_MERGES = 1 << 19


def byte_letters() -> list[str]:
    """A printable character for each byte: the printable ones of Latin-1 stand for themselves, the others for the
    code points from 256, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, beyond = [], 0
    for b in range(256):
        letters.append(chr(b) if b in own else chr(256 + beyond))
        beyond += b not in own
    return letters


def lettered(data: Column) -> Column:
    """The letters of bytes, as a text."""
    own = [(chr(b), x) for b, x in enumerate(byte_letters()) if chr(b) != x]
    # Latin-1 has a character for each byte.
    return F.translate(F.decode(data, "ISO-8859-1"), *map("".join, zip(*own, strict=True)))


def byte_symbols(text: Column) -> Column:
    """The letters of a text's UTF-8 bytes, as an array."""
    return F.when(F.octet_length(text) > 0, F.split(lettered(F.encode(text, "UTF-8")), "")).otherwise(F.array().cast("array<string>"))


def from_byte_symbols(symbols: Column) -> Column:
    """The text of an array of symbols; bytes that aren't UTF-8 become replacement characters."""
    letters = F.lit("".join(byte_letters()))
    joined = F.array_join(symbols, "")
    byte = F.transform(F.filter(F.split(joined, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.instr(letters, c) - 1), 2, "0"))
    return F.decode(F.unhex(F.array_join(byte, "")), "UTF-8")


def _joined(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """symbols after all merges.  Pairs wait in a heap by rank and place, so the work is that of the symbols."""
    out, n = list(symbols), len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]  # noqa: B905
    heapq.heapify(heap)
    while heap:
        rank, new = heap[0][0], []
        # All places of the pair, from the left; what they make is looked at after the last of them.
        while heap and heap[0][0] == rank:
            i = heapq.heappop(heap)[1]
            j = after[i]
            if 0 < j < n and ranks.get((out[i], out[j])) == rank:
                out[i] += out[j]
                # What was joined to its left has nothing after it.
                after[i], after[j] = after[j], 0
                if after[i] < n:
                    before[after[i]] = i
                new.append(i)
        for i in new:
            for a in (before[i], i):
                if a >= 0 and 0 < after[a] < n and (found := ranks.get((out[a], out[after[a]]))) is not None:
                    heapq.heappush(heap, (found, a))
    return [x for x, a in zip(out, after, strict=True) if a]


def _lists(column: pa.ListArray) -> list[list[str] | None]:
    """to_pylist, which makes one text of equal ones."""
    flat, n = column.flatten().dictionary_encode(), pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    texts = np.array([*flat.dictionary.to_pylist(), None], object)[pc.fill_null(flat.indices, -1).to_numpy(zero_copy_only=False)].tolist()
    ends = np.cumsum(n).tolist()
    return [texts[b:e] if valid else None for b, e, valid in zip([0, *ends], ends, column.is_valid().to_pylist())]  # noqa: B905


def _rows(ranks=None):
    """Batches of word, symbols and, without ranks, the pairs that each word may need, by rank."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = _lists(batch.column(1))
            if ranks is not None:
                found = [x and _joined(x, ranks.value) for x in symbols]
            else:
                own = ({(p["left"], p["right"]): i for i, p in enumerate(x or [])} for x in batch.column(2).to_pylist())
                found = [x and _joined(x, r) for x, r in zip(symbols, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, batch.column(1).type)], ["word", "symbols"])

    return rows


def _with_merges(words: DataFrame, merges: DataFrame) -> DataFrame:
    """words with pairs: the merges whose joined text is that of adjacent symbols of the word, by rank."""
    longest = merges.agg(F.max(F.char_length("left") + F.char_length("right"))).first()[0]
    at = words.where(F.size("symbols") > 1).select("word", "symbols", F.explode(F.sequence(F.lit(1), F.size("symbols") - 1)).alias("at"))
    sizes = F.sequence(F.lit(2), F.least(F.lit(longest), F.size("symbols") - F.col("at") + 1))
    runs = at.where(F.lit(longest) >= 2).select("word", "symbols", "at", F.explode(sizes).alias("n"))
    texts = runs.select("word", F.array_join(F.slice("symbols", F.col("at"), F.col("n")), "").alias("text")).distinct()
    met = texts.join(merges.withColumn("text", F.concat("left", "right")), "text").groupBy("word")
    by_rank = F.transform(F.sort_array(F.collect_list(F.struct("rank", "left", "right"))), lambda p: F.struct(p["left"].alias("left"), p["right"].alias("right")))
    return words.join(met.agg(by_rank.alias("pairs")), "word", "left")


def merged(words: DataFrame, merges: DataFrame) -> DataFrame:
    """(word, symbols) after all merges: in each word the pair of least rank is joined wherever it stands, from the left,
    until no pair of merges is in it.

    words has word (distinct) and symbols (array<string>, none empty); merges has rank, left and right, a pair once.  A word
    is merged in its row: with all merges, if they are few enough for a broadcast, else with those that it can need.
    """
    rows = words.select("word", "symbols")
    schema = rows.schema
    known = written(merges.select("rank", "left", "right").dropna(), "merges")
    if known.count() > BROADCAST_MERGES:
        return _with_merges(rows, known).select("word", "symbols", "pairs").mapInArrow(_rows(), schema)
    pairs = known.orderBy("rank").select("left", "right").toArrow().to_pydict()
    ranks = {p: i for i, p in enumerate(zip(pairs["left"], pairs["right"], strict=True))}
    return rows.mapInArrow(_rows(words.sparkSession.sparkContext.broadcast(ranks)), schema)
