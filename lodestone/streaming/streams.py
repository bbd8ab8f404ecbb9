"""Unbounded sources and state: piped lines, first occurrences, conversations and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CONVERSATION = "conv_id long, first_turn long, last_turn long, n_turns long, history string"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def piped(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated lines of a text stream as named columns; missing fields are null."""
    parts = F.split("value", "\t")
    return lines.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def first_seen(rows: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Each value of keys once while the watermark keeps it."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def tumbling(rows: DataFrame, time: str, size: str, late: str, key: str, value: str) -> DataFrame:
    g = rows.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(rows: DataFrame, time: str, size: str, step: str, late: str, key: str) -> DataFrame:
    g = rows.withWatermark(time, late).groupBy(F.window(time, size, step), key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), key, "n")


def sessions(rows: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    g = rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


class _Conversation(StatefulProcessor):
    """The newest turns of a conversation that fit, the number of all, and when it was last heard of."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, role string, text string")
        self.count = handle.getValueState("count", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def _fitting(self, turns: list[tuple]) -> list[tuple]:
        """Whole turns from the newest back, as long as they fit together; the newest stays in any case."""
        turns = sorted(turns, key=lambda t: [(x is None, x) for x in t])
        size, first = 0, len(turns)
        for i in range(len(turns) - 1, -1, -1):
            size += len(_line(*turns[i][1:]))
            if size > self.keep and i < len(turns) - 1:
                break
            first = i
        return turns[first:]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        n = self.count.get()[0] if self.count.exists() else 0
        for batch in rows:
            n += len(batch)
            found = zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in ("turn", "role", "text")), strict=True)
            # What a newer turn has pushed out stays out, so batches may come in any order.
            held = self._fitting(held + [(None if t is None else int(t), r, x) for t, r, x in found])
        self.turns.put(held)
        self.count.update((n,))
        if self.idle_ms is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        history = "".join(_line(*t[1:]) for t in held)
        yield pd.DataFrame({"conv_id": [key[0]], "first_turn": [held[0][0]], "last_turn": [held[-1][0]], "n_turns": [n], "history": [history]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.count.clear()
        self.timer.clear()
        yield pd.DataFrame({"conv_id": [], "first_turn": [], "last_turn": [], "n_turns": [], "history": []}).astype({"history": object, "conv_id": "int64", "first_turn": "int64", "last_turn": "int64", "n_turns": "int64"})

    def close(self) -> None:
        pass


def _line(role: str | None, text: str | None) -> str:
    return f"{role or ''}: {text or ''}\n"


def conversation_state(turns: DataFrame, keep: int = 4096, idle_ms: int | None = None) -> DataFrame:
    """A row (conv_id, first_turn, last_turn, n_turns, history) for each conversation and micro-batch with turns of it.

    turns has conv_id, turn, role and text.  n_turns counts all turns so far.  The history ends with the newest turn (by
    turn, role, text) and begins with a whole one: as many as have keep characters together, the newest however long it
    is.  Turns may come in any order.  So neither state nor output of a conversation grows with its length, and
    a micro-batch takes a batch of rows at a time; after idle_ms without a turn, if given, it is forgotten.
    """
    return turns.groupBy("conv_id").transformWithStateInPandas(_Conversation(keep, idle_ms), CONVERSATION, "Append", "ProcessingTime" if idle_ms is not None else "None")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", empty_batches: bool = True) -> DataFrame:
    """Runs a stream over what is there now, into Parquet, and reads it.  State is kept in RocksDB.

    A stream with timers of processing time needs empty_batches False: it would wait for them without end, while those
    that run out later are of a later run.
    """
    spark: SparkSession = stream.sparkSession
    settings = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _EMPTY_BATCHES: str(empty_batches).lower()}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(path)
