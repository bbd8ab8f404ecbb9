"""Token streams for language models: shifted targets, parallel streams, and sentences packed into several streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import chance
from .sequences import running


def parallel_streams(tokens: DataFrame, nth: str, token: str, streams: int, steps: int) -> DataFrame:
    """(batch, stream, at, token, target) from tokens numbered from 0.

    The tokens are cut into streams of equal length, the rest is dropped; a batch has up to steps
    tokens of each stream, and a token's target is the one after it in its stream.  Only arithmetic on
    the numbers and one equi-join, so no stream meets in one task.
    """
    total = tokens.count()
    length = total // streams
    rows = tokens.where(F.col(nth) < length * streams).select(F.floor(F.col(nth) / max(length, 1)).cast("int").alias("stream"), (F.col(nth) % max(length, 1)).alias("place"), F.col(token).alias("token"))
    after = rows.select("stream", (F.col("place") - 1).alias("place"), F.col("token").alias("target"))
    both = rows.join(after, ["stream", "place"])
    return both.select(F.floor(F.col("place") / steps).alias("batch"), "stream", (F.col("place") % steps).alias("at"), "token", "target")


def fixed_batches(tokens: DataFrame, length: int, steps: int) -> DataFrame:
    """(batch, start, size): batches of steps places of streams of length, whose last place has no target."""
    n = max(0, -(-(length - 1) // steps))
    return tokens.sparkSession.range(n).select(F.col("id").alias("batch"), (F.col("id") * steps).alias("start"), F.least(F.lit(steps), length - 1 - F.col("id") * steps).alias("size"))


def variable_batches(tokens: DataFrame, length: int, steps: int, std: float = 5.0, shortest: int = 5, deviations: int = 3, seed: int = 0) -> DataFrame:
    """(batch, start, size) of batches of random sizes, one behind the other, for streams of length.

    A size is drawn from a normal distribution around steps (1 in 20: around half of it), without its fraction, and is from
    shortest to steps + deviations * std.  The last batch ends before the last place, and none begins at one of the last two.  A
    batch's draw is a hash of its number, so all batches are drawn at once and their starts are running sums.
    """
    n = -(-length // shortest) + 1
    longest = steps + deviations * std
    rows = tokens.sparkSession.range(n).withColumnRenamed("id", "batch")
    around = F.when(chance(F.col("batch") * 3, seed) < 0.95, float(steps)).otherwise(steps / 2)
    # Two even draws are a normal one.
    normal = F.sqrt(-2 * F.log(1 - chance(F.col("batch") * 3 + 1, seed))) * F.cos(2 * math.pi * chance(F.col("batch") * 3 + 2, seed))
    drawn = F.least(F.lit(longest), F.greatest(F.lit(float(shortest)), (around + std * normal).cast("bigint").cast("double"))).cast("bigint")
    upto = running(rows.withColumn("size", drawn), ["batch"], {"upto": "size"})
    starts = upto.select("batch", (F.col("upto") - F.col("size")).alias("start"), "size")
    return starts.where((F.col("start") < length - 2) | ((F.col("batch") == 0) & F.lit(length > 1))).withColumn("size", F.least("size", length - 1 - F.col("start")))


def stream_batches(tokens: DataFrame, nth: str, token: str, streams: int, batches, look_back: int = 0) -> DataFrame:
    """(batch, stream, at, token, target): as parallel_streams, with batches (tokens, length -> batch, start, size) of their own sizes.

    at counts from 0; the look_back places before a batch come with it below 0, without a target.
    """
    length = tokens.count() // streams
    at = F.explode(F.sequence(-F.least(F.lit(look_back).cast("bigint"), F.col("start")), F.col("size") - 1)).alias("at")
    places = batches(tokens, length).where("size > 0").select("batch", "start", at).select("batch", "at", (F.col("start") + F.col("at")).alias("place"))
    rows = tokens.where(F.col(nth) < length * streams).select(F.floor(F.col(nth) / max(length, 1)).cast("int").alias("stream"), (F.col(nth) % max(length, 1)).alias("place"), F.col(token).alias("token"))
    after = rows.select("stream", (F.col("place") - 1).alias("place"), F.col("token").alias("target"))
    # Places come from a few numbers of batches, which Spark would judge a broadcast by.
    both = rows.join(after, ["stream", "place"], "left").join(places.hint("merge"), "place")
    return both.select("batch", "stream", "at", "token", F.when(F.col("at") >= 0, F.col("target")).alias("target"))


class _Filled:
    """Streams that are filled in turn from one line of sentences; what is left of a sentence stays with its stream."""

    def __init__(self, streams: int, steps: int, look_back: int):
        self.steps, self.look_back = steps, look_back
        self.left: list[list[np.ndarray]] = [[] for _ in range(streams)]
        self.ready = [0] * streams
        self.before: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(streams)]
        self.stream = self.batch = 0

    def add(self, sentence: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Takes a sentence; yields batch, stream, data and targets of the batch that is full by it, if one is."""
        if len(sentence) < 2:
            return
        self.left[self.stream].append(sentence)
        self.ready[self.stream] += len(sentence) - 1
        # Streams that have enough from before take nothing.
        while self.ready[self.stream] >= self.steps:
            self.stream += 1
            if self.stream == len(self.left):
                yield from self._batch()
                self.batch, self.stream = self.batch + 1, 0

    def _batch(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for i, held in enumerate(self.left):
            data, target, need = [self.before[i]], [], self.steps
            while need:
                s = held[0]
                n = min(len(s) - 1, need)
                data.append(s[:n])
                target.append(s[1 : n + 1])
                need -= n
                if n == len(s) - 1:
                    held.pop(0)
                else:
                    held[0] = s[n:]
            self.ready[i] -= self.steps
            whole = np.concatenate(data)
            self.before[i] = whole[len(whole) - min(len(whole), self.look_back) :]
            yield self.batch, i, whole, np.concatenate(target)


def _packed(streams: int, steps: int, look_back: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled, out = None, None, []

        def flushed() -> pa.RecordBatch:
            parts, numbers, places, data, target = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(numbers, pa.int64()), pa.array(places, pa.int32()), pa.array(data, pa.list_(pa.int64())), pa.array(target, pa.list_(pa.int64()))], ["part", "batch", "stream", "data", "target"])

        for batch in batches:
            names, tokens = batch.column("part").to_pylist(), batch.column("tokens")
            for i, name in enumerate(names):
                if name != part:
                    part, filled = name, _Filled(streams, steps, look_back)
                found = tokens[i].values
                if found is None:
                    continue
                for n, at, data, target in filled.add(found.to_numpy(zero_copy_only=False).astype(np.int64)):
                    out.append((part, n, at, data, target))
                if len(out) * (steps + look_back) > 1 << 16:
                    yield flushed()
                    out.clear()
        if out:
            yield flushed()

    return rows


def shuffled_streams(sentences: DataFrame, streams: int, steps: int, look_back: int = 0, seed: int | None = None, part_sentences: int = 1 << 20) -> DataFrame:
    """(part, batch, stream, data, target): sentences (file, id, tokens) one behind the other in several streams.

    In a batch, each stream in turn is filled up to steps places: from what is left of its sentence, then from the next
    sentences of the file, in order of id, or with a seed in order of a hash.  A sentence's last token is only a target; one of
    fewer than two tokens, or null, is passed over.  From the second batch on the look_back places before are in data too.
    Streams that can't be filled any more, and with them the last incomplete batch, are dropped.

    Which stream takes a sentence depends on all before it, so a file is gone through in order, holding one sentence for
    each stream.  One of more than part_sentences is cut by the hash into parts that are packed by themselves, as
    if they were files, so that no task's work grows with a file.
    """
    key = F.xxhash64(F.lit(seed or 0), "id")
    sizes = sentences.groupBy("file").agg(F.ceil(F.count("*") / part_sentences).cast("int").alias("_parts"))
    rows = sentences.join(sizes.withColumnRenamed("file", "_file"), F.col("file").eqNullSafe(F.col("_file"))).withColumn("_key", key)
    rows = rows.withColumn("part", F.concat(F.coalesce("file", F.lit("")), F.when(F.col("_parts") > 1, F.concat(F.lit(" "), F.pmod("_key", F.col("_parts")).cast("string"))).otherwise("")))
    order = ["part", "id"] if seed is None else ["part", "_key", "id"]
    rows = rows.repartition("part").sortWithinPartitions(*order).select("part", F.col("tokens").cast("array<bigint>").alias("tokens"))
    return rows.mapInArrow(_packed(streams, steps, look_back), "part string, batch long, stream int, data array<long>, target array<long>")
