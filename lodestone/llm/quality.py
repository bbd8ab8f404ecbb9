"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (at most PASSAGE bytes between line feeds), of which only the whole
has a label.  Every passage is encoded from its bytes: shares of character classes and of hashed
byte pairs, then a learned layer.  Gated attention ``w . (tanh(V h) * sigmoid(U h))`` weighs the
encoded passages, and a logistic unit scores the weighted sum.  All layers are learned together.

The model is fitted with numpy on the driver, on a bounded sample of labelled documents; scoring
goes over every passage of every document in Spark, however many a document has, in bounded memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, released, written

PASSAGE = 512
#: At most so many labelled documents of each label are learned from, whose features take so many bytes together; all of
#: their passages are.
TRAIN_DOCS, TRAIN_BYTES = 2000, 64 << 20
ENCODED, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 32, 16, 40, 64, 3e-3, 1e-4
THRESHOLD = 0.7
#: A passage of so many bytes is drawn half way to the average one, so that a few words aren't odd.
SHRINK = 40
_PAIRS = 64
#: Bytes of a text, and passages, that are encoded at once.
_CHUNK, _SLICE = 1 << 18, 4096


def _byte_classes() -> tuple[np.ndarray, int]:
    """Letters by case, digits, other ASCII characters each, and the kinds of UTF-8 bytes."""
    kind = np.zeros(256, np.int64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[128:192], kind[192:224], kind[224:256] = 3, 4, 5
    n = 6
    for b in (b for b in range(128) if not chr(b).isalnum()):
        if b < 32 and b not in (9, 10, 13):
            kind[b] = 6
            continue
        n += 1
        kind[b] = n
    return kind, n + 1


_CLASS, _CLASSES = _byte_classes()
FEATURES = _CLASSES + _PAIRS + 2


def _begins(data: np.ndarray) -> np.ndarray:
    """Where the passages of a part of a text begin that begins with one; an empty text has one empty passage."""
    cuts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    cuts = cuts[:-1] if len(cuts) > 1 and cuts[-1] == len(data) else cuts
    lengths = np.diff(np.append(cuts, len(data)))
    pieces = np.maximum(1, -(-lengths // PASSAGE))
    return np.repeat(cuts, pieces) + PASSAGE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))


def _parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of a text of about _CHUNK bytes, cut where passages begin, and the byte after each (or none)."""
    at = 0
    while True:
        end = min(len(data), at + _CHUNK)
        if end < len(data):
            ends = np.flatnonzero(data[at:end] == 10)
            end = at + (int(ends[-1]) + 1 if len(ends) else _CHUNK // PASSAGE * PASSAGE)
        yield data[at:end], data[end : end + 1]
        at = end
        if at >= len(data):
            return


def _encoded(data: np.ndarray, after: np.ndarray) -> Iterator[np.ndarray]:
    """Features of the passages of a part of a text, _SLICE of them at a time."""
    begins = _begins(data)
    pair = np.zeros(len(data), np.uint8)
    following = np.concatenate([data[1:], after]).astype(np.int32)
    pair[: len(following)] = (data[: len(following)].astype(np.int32) * 37 + following * 101) % 251 % _PAIRS  # a text's last byte has no other
    ends = np.append(begins[1:], len(data))
    for i in range(0, len(begins), _SLICE):
        a, b = begins[i], ends[min(i + _SLICE, len(begins)) - 1]
        lengths = ends[i : i + _SLICE] - begins[i : i + _SLICE]
        n = len(lengths)
        owner = np.repeat(np.arange(n), lengths)
        kinds = np.bincount(owner * _CLASSES + _CLASS[data[a:b]], minlength=n * _CLASSES).reshape(n, _CLASSES)
        pairs = np.bincount(owner * _PAIRS + pair[a:b], minlength=n * _PAIRS).reshape(n, _PAIRS)
        size = np.maximum(lengths, 1)[:, None]
        yield np.concatenate([np.sqrt(kinds / size), np.sqrt(pairs / size), np.log1p(lengths)[:, None] / 6, (lengths == 0)[:, None]], axis=1).astype(np.float32)


def _bytes_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text; null ones are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return (data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def encode_passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all passages of some whole documents and where each document's begin, several documents at a time."""
    held, first, size = [], [0], 0
    for data in _bytes_of(texts):
        x = [x for part, after in _parts(data) for x in _encoded(part, after)]
        held += x
        first.append(first[-1] + sum(map(len, x)))
        size += len(data)
        if size >= _CHUNK or first[-1] >= _SLICE:
            yield np.concatenate(held), np.array(first)
            held, first, size = [], [0], 0
    if held:
        yield np.concatenate(held), np.array(first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """first: where each bag begins in x, and the end."""
        w, out = self.weights, {}
        size = np.expm1(6 * x[:, -2:-1])
        out["x"] = (x - self.mean) / self.scale * (size / (size + SHRINK))
        out["h"] = np.tanh(out["x"] @ w["E"] + w["e"])
        out["v"], out["u"] = np.tanh(out["h"] @ w["V"]), _sigmoid(out["h"] @ w["U"])
        a = (out["v"] * out["u"]) @ w["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(a - np.maximum.reduceat(a, first[:-1])[bag])
        out["bag"], out["a"] = bag, a / np.add.reduceat(a, first[:-1])[bag]
        out["z"] = np.add.reduceat(out["a"][:, None] * out["h"], first[:-1], axis=0)
        out["p"] = _sigmoid(out["z"] @ w["c"] + w["b"])
        return out

    def attention(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoded passages, and what the softmax is taken of."""
        w = self.weights
        size = np.expm1(6 * x[:, -2:-1])
        h = np.tanh(((x - self.mean) / self.scale * (size / (size + SHRINK))) @ w["E"] + w["e"])
        return h, (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"]

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Of each document; one of many passages is read a slice at a time, carrying the greatest attention so far and
        the sums of the weights and of the weighted passages relative to it."""
        found, waiting, n = [], [], 0

        def together() -> np.ndarray:
            first = np.concatenate([[0], np.cumsum([len(x) for x in waiting])])
            return self.forward(np.concatenate(waiting), first)["p"]

        for data in _bytes_of(texts):
            slices = (x for part, after in _parts(data) for x in _encoded(part, after))
            x = next(slices)
            more = next(slices, None)
            if more is None:
                if n + len(x) > _SLICE and waiting:
                    found.append(together())
                    waiting, n = [], 0
                waiting.append(x)
                n += len(x)
                continue
            if waiting:
                found.append(together())
                waiting, n = [], 0
            top, weight, total = -np.inf, 0.0, np.zeros(ENCODED)
            for x in itertools.chain([x, more], slices):
                h, a = self.attention(x)
                new = max(top, a.max())
                e, before = np.exp(a - new), np.exp(top - new)
                top, weight, total = new, weight * before + e.sum(), total * before + e @ h
            found.append(np.atleast_1d(_sigmoid(total / weight @ self.weights["c"] + self.weights["b"])))
        if waiting:
            found.append(together())
        return np.concatenate(found) if found else np.zeros(0)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        w, o = self.weights, self.forward(x, first)
        d = importance * (o["p"] - y) / len(y)
        g = {"c": o["z"].T @ d, "b": np.array([d.sum()])}
        dz = (d[:, None] * w["c"])[o["bag"]]
        da = (dz * o["h"]).sum(axis=1)
        da = o["a"] * (da - np.add.reduceat(o["a"] * da, first[:-1])[o["bag"]])
        g["w"] = (o["v"] * o["u"]).T @ da
        dv = da[:, None] * w["w"] * o["u"] * (1 - o["v"] ** 2)
        du = da[:, None] * w["w"] * o["v"] * o["u"] * (1 - o["u"])
        g["V"], g["U"] = o["h"].T @ dv, o["h"].T @ du
        dh = (o["a"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - o["h"] ** 2)
        g["E"], g["e"] = o["x"].T @ dh, dh.sum(axis=0)
        return g


def fit(bags: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, seed: int = 7) -> AttentionModel:
    """Adam over mini-batches of bags, with a fixed seed."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {"E": draw(FEATURES, ENCODED), "e": np.zeros(ENCODED), "V": draw(ENCODED, ATTENTION), "U": draw(ENCODED, ATTENTION), "w": draw(ATTENTION), "c": draw(ENCODED), "b": np.zeros(1)}
    model = AttentionModel(every.mean(axis=0), every.std(axis=0) + 0.02, weights)
    step = 0
    m, v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            step += 1
            for k, g in model.gradients(x, first, labels[chosen], importance[chosen]).items():
                g = g + DECAY * weights[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                weights[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc32_of(doc_id), F.lit(4)) == 2, F.lit(False))


@released
def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for x, first in encode_passages(batch.column(1)):
            bags += [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["label", "bag"])


def _sample(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """label and text of the documents that are learned from: of each label the first by a hash of doc_id,
    as long as they are few and their features small enough together; one that would exceed TRAIN_BYTES is passed over."""
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).orderBy(F.xxhash64("labelled"), "labelled").limit(TRAIN_DOCS)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * TRAIN_DOCS rows.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    found = written(found.groupBy("labelled", "label").agg(F.min("text").alias("text")), "quality-sample")
    held, short = {0: 0, 1: 0}, []
    # A text has at most so many passages: its line feeds, those of whole PASSAGEs, and one more.
    octets = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    lines = octets - F.coalesce(F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0))
    for r in found.select("labelled", "label", ((lines + F.floor(octets / PASSAGE) + 1) * (4 * FEATURES)).alias("size")).orderBy(F.xxhash64("labelled"), "labelled").collect():
        if held[r["label"]] + r["size"] <= TRAIN_BYTES:
            held[r["label"]] += r["size"]
            short.append(r["labelled"])
    return found.where(F.col("labelled").isin(short) if short else F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """The model for docs (doc_id, text) and labels (doc_id, quality 0 or 1), from labelled rows that
    are not held out; see _sample for how many.

    Samples count as much as all rows of their label together, so scores keep the labels' shares.  A doc_id
    labelled both ways says nothing and is left out; of several texts with one doc_id the least is learned
    from; further columns of either table are ignored.  Without a row of each label, the model scores every
    document by the share there is (1 if none).
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("labelled"))
    usable = usable.agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("other")).where("label = other").select("labelled", "label")
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    one = totals.get(1, 0)
    if not one or not totals.get(0):
        return constant(-8.0 if totals.get(0) else 8.0)
    bags = _sample(docs, usable).select("label", "text").mapInArrow(_bag_rows, "label int, bag binary").toArrow()
    y = bags["label"].to_numpy().astype(float)
    if len(y) == 0:
        return constant(8.0 if one > totals[0] else -8.0)
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in bags["bag"].to_pylist()]
    order = sorted(range(len(x)), key=lambda i: (y[i], x[i].tobytes()))
    share = one / (one + totals[0])
    importance = np.where(y == 1, share * len(y) / max(1, (y == 1).sum()), (1 - share) * len(y) / max(1, (y == 0).sum()))
    return fit([x[i] for i in order], y[order], importance[order])


def constant(b: float) -> AttentionModel:
    """The model whose score is the logistic of b for every document."""
    weights = {"E": np.zeros((FEATURES, ENCODED)), "e": np.zeros(ENCODED), "V": np.zeros((ENCODED, ATTENTION)), "U": np.zeros((ENCODED, ATTENTION)), "w": np.zeros(ATTENTION), "c": np.zeros(ENCODED)}
    return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), {**weights, "b": np.array([b])})


def _scored(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.scores(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "score"])

    return released(rows)


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each row of docs (doc_id, text).

    Null and empty texts are scored as one empty passage; repeated rows, and null doc_ids (never
    held out), are scored like any other; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_scored(shared), f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to be good, with all their columns, whatever their names.

    Null and empty texts are scored as one empty passage; repeated rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(batch.schema.get_field_index("text"))) >= THRESHOLD))

    return docs.mapInArrow(released(rows), docs.schema)
