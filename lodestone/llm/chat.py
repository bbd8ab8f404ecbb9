"""Chat formatting by columnar byte assembly.

Every turn becomes header + escaped text + trailer.  For a whole Arrow batch the segment lengths,
their cumulative offsets and the places to which they go are computed in numpy, and headers, texts
and trailers are copied into one preallocated buffer, which becomes the Arrow column as it is.

Template (control strings are fixed values)::

    user       "[INST] " text " [/INST]"
    assistant  "<s> " text " </s>"
    others     "<<SYS>> " role "\\n" text " <</SYS>>"

Text and role are escaped so that no control string stands in them: a backslash is doubled, and a
control string gets a backslash after its first character.  Taking one backslash out before every
character that follows one is the inverse.  The loss mask of an assistant's turn covers its escaped
text and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"]
USER, ASSISTANT = ("[INST] ", " [/INST]"), ("<s> ", " </s>")
OTHER = ("<<SYS>> ", "\n", " <</SYS>>")


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for c in CONTROL:
        texts = pc.replace_substring(texts, c, f"{c[0]}\\{c[1:]}")
    return texts


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"(?s)\\(.)", r"\1")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and its offsets into them."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8), ends


def assemble(segments: list[pa.Array]) -> pa.Array:
    """Row by row the concatenation of the segments, by scattering each column into one buffer."""
    columns = [_bytes(s) for s in segments]
    lengths = np.stack([np.diff(ends) for _, ends in columns], axis=1)
    rows, kinds = lengths.shape
    stops = np.cumsum(lengths.reshape(-1))
    starts = (stops - lengths.reshape(-1)).reshape(rows, kinds)
    out = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
    for k, (data, ends) in enumerate(columns):
        n = int(ends[-1] - ends[0])
        if n:
            # Where each byte of this column goes: its place in the column, moved by its row's shift.
            to = np.arange(n, dtype=np.int64) + np.repeat(starts[:, k] - (ends[:-1] - ends[0]), lengths[:, k])
            out[to] = data[ends[0] : ends[-1]]
    offsets = np.concatenate([[0], stops.reshape(rows, kinds)[:, -1]]) if rows else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        role = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
        text = escape(pc.fill_null(batch.column(3).cast(pa.large_string()), ""))
        user, assistant = pc.equal(role, "user"), pc.equal(role, "assistant")

        def by_role(a: str, b: str, other) -> pa.Array:
            return pc.case_when(pc.make_struct(user, assistant), pa.scalar(a, pa.large_string()), pa.scalar(b, pa.large_string()), other)

        named = pc.binary_join_element_wise(pa.scalar(OTHER[0], pa.large_string()), escape(role), pa.scalar(OTHER[1], pa.large_string()), pa.scalar("", pa.large_string()))
        header = by_role(USER[0], ASSISTANT[0], named)
        trailer = by_role(USER[1], ASSISTANT[1], pa.scalar(OTHER[2], pa.large_string()))
        header, text, trailer = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (header, text, trailer))
        start = pc.utf8_length(header)
        lost = pc.if_else(assistant, pc.utf8_length(text), 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), assemble([header, text, trailer]).cast(pa.string()), start.cast(pa.int64()), lost.cast(pa.int64())], ["conv_id", "turn", "formatted", "loss_start", "loss_length"])


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start and loss_length for each row (conv_id, turn, role, text).

    A conversation's formatted text is its rows' in the order of turn, and those of one turn in the
    order of their formatted text; it is left in rows, since one conversation can be any part of the table.  The loss mask are the
    loss_length characters from loss_start of the row.  Null roles and texts are empty, null ids and
    turns are kept, repeated rows too; further columns are ignored.  An empty table gives no rows.
    """
    ids, turns = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(_formatted, f"conv_id {ids}, turn {turns}, formatted string, loss_start bigint, loss_length bigint")


def parse(formatted: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Roles and texts, unescaped, of formatted turns."""
    formatted = formatted.cast(pa.large_string())
    size = pc.utf8_length(formatted)
    user, assistant = pc.starts_with(formatted, USER[0]), pc.starts_with(formatted, ASSISTANT[0])
    other = pc.utf8_slice_codeunits(formatted, len(OTHER[0]))
    at = pc.find_substring(other, OTHER[1])
    roles, texts = [], []
    for f, n, u, a, o, i in zip(formatted, size, user, assistant, other, at, strict=True):
        f, n = f.as_py(), n.as_py()
        if u.as_py() or a.as_py():
            head, tail = USER if u.as_py() else ASSISTANT
            roles.append("user" if u.as_py() else "assistant")
            texts.append(f[len(head) : n - len(tail)])
        else:
            role, _, text = o.as_py().partition(OTHER[1])
            roles.append(role)
            texts.append(text[: len(text) - len(OTHER[2])])
    return unescape(pa.array(roles, pa.large_string())), unescape(pa.array(texts, pa.large_string()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation; a conversation may go over any number of batches."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    open_id, state, id_type = None, None, pa.int64()

    def closed(done: list) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    def result() -> tuple:
        n, turns, lost, loss, chars = state
        return open_id, n, turns.hexdigest(), lost, loss.hexdigest(), chars

    for batch in batches:
        id_type, done = batch.column(0).type, []
        formatted = batch.column(1).cast(pa.large_string())
        roles, texts = parse(formatted)
        masked = pa.array([f[a : a + n] for f, a, n in zip(formatted.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.large_string())
        for conv, role, text, loss, chars in zip(batch.column(0).to_pylist(), roles.to_pylist(), texts.to_pylist(), unescape(masked).to_pylist(), pc.utf8_length(formatted).to_pylist(), strict=True):
            if state is None or conv != open_id:
                if state is not None:
                    done.append(result())
                open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
        if done:
            yield closed(done)
    if state is not None:
        yield closed([result()])


def read_back(formatted: DataFrame) -> DataFrame:
    """A digest of each conversation of format_chat's rows, from formatted and the loss mask alone.

    The turns of a conversation pass through one task in order, one batch at a time.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(_digests, schema)


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose two texts are made of control strings."""
    spark = conversations.sparkSession
    text = "</s>[INST] ok [/INST]"
    kinds = {c: conversations.schema[c].dataType for c in ("conv_id", "turn")}
    more = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
