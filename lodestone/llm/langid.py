"""Language of documents and of the spans in them.

A text is cut into words, each of one script.  The script, found by ranges of code points, narrows the
languages that a word can be of to those that use it; among them the word's character runs are scored by
hashed counts.  The Viterbi path over the scores of all words, with a penalty for each switch, labels the
spans of a text; its language is that of most letters.

Counts are summed in Spark over a sample of the labelled documents.  Paths of many texts are found side by
side in numpy, in blocks of words: a block's best scores from any language to any other join it to the next.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, crc32_of, released

#: Ranges of code points of the scripts told apart; letters of others share one more.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
UNKNOWN = "und"
#: Expected bytes of text of each language that are learned from, and entries of all languages' tables together.
TRAIN_BYTES, TABLE = 8 << 20, 1 << 21
#: Runs of so many letters are hashed; a run without spaces is cut into words of so many code points.
RUNS, WORD_MAX = (2, 3, 4), 24
#: A script is a language's if so much of its letters is in it.
SCRIPT_SHARE = 0.005
#: In nats: what a switch costs, what a word can speak against a language of its script at most, and against one of others.
SWITCH, WORD_LIMIT, OTHER_SCRIPT = 10.0, 6.0, 12.0
_CHUNK, _BLOCK, _SMOOTH = 1 << 19, 256, 0.5


@functools.cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its script if it is a letter (else -1; -2: a mark, which prolongs a word), and its lower case."""
    kind, lower = np.full(0x110000, -1, np.int8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x40000):
        c = chr(i)
        category = unicodedata.category(c)
        if category[0] == "L":
            kind[i] = len(SCRIPTS)
            small = c.lower()
            if len(small) == 1:
                lower[i] = ord(small)
        elif category[0] == "M":
            kind[i] = -2
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            kind[a : b + 1][kind[a : b + 1] >= 0] = k
    return kind, lower


@dataclass
class Words:
    """Words of some texts: where each begins, how long it is, its letters, its script, its text and its code among distinct."""

    begins: np.ndarray
    lengths: np.ndarray
    letters: np.ndarray
    owner: np.ndarray
    script: np.ndarray
    code: np.ndarray
    distinct: pa.Array


def cut_words(points: np.ndarray, ends: np.ndarray) -> Words:
    """points: code points of the texts one behind another; ends: where each begins, and the end."""
    kinds, lower = _code_points()
    kind = kinds[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[ends] = True
    first = first[:n]
    # A mark is of the script of the letter before it, in the same text.
    at = np.where((kind != -2) | first, np.arange(n), 0)
    kind = kind[np.maximum.accumulate(at)] if n else kind
    inside = kind >= 0
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    begins = np.flatnonzero(inside & (change | first))
    runs = np.flatnonzero(change | first)
    lengths = np.diff(np.append(runs, n))[np.searchsorted(runs, begins)]
    pieces = -(-lengths // WORD_MAX)
    if len(pieces) and pieces.max() > 1:
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins, lengths = np.repeat(begins, pieces) + WORD_MAX * within, np.minimum(WORD_MAX, np.repeat(lengths, pieces) - WORD_MAX * within)
    count = np.concatenate([[0], np.cumsum(kinds[points] >= 0)])
    flat = lower[points[inside]].astype(np.uint32)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets * 4), pa.py_buffer(flat)])
    coded = texts.dictionary_encode()
    return Words(begins, lengths, count[begins + lengths] - count[begins], np.searchsorted(ends, begins, "right") - 1, kind[begins], coded.indices.to_numpy(), coded.dictionary)


def features(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's runs and of itself, and where each word's begin."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8) // 4
    flat = np.frombuffer(words.buffers()[2], np.uint32)[offsets[0] : offsets[-1]].astype(np.uint64)
    lengths = np.diff(offsets)
    # An edge (0) stands before and behind each word.
    size = lengths + 2
    begins = np.cumsum(size) - size
    text = np.zeros(int(size.sum()), np.uint64)
    text[np.arange(len(flat)) + np.repeat(2 * np.arange(len(words)) + 1, lengths)] = flat
    left = np.repeat(begins + size, size) - np.arange(len(text))
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    each, owners = [], []
    word = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        for n in RUNS:
            h = np.full(max(0, len(text) - n + 1), n, np.uint64)
            for k in range(n):
                h = (h ^ text[k : k + len(h)]) * multiplier
                h ^= h >> np.uint64(29)
            fits = left[: len(h)] >= n
            each.append(h[fits])
            owners.append(word[: len(h)][fits])
        # The word: a sum of its letters, each hashed with its place.
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint64)
        h = (flat + (place << np.uint64(24)) + np.uint64(1)) * multiplier
        h = (h ^ (h >> np.uint64(31))) * multiplier
        whole = np.add.reduceat(h, np.cumsum(lengths) - lengths) if len(words) else h
        each.append(whole ^ (whole >> np.uint64(32)))
        owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    hashed = (np.concatenate(each)[order] % np.uint64(buckets)).astype(np.int64)
    return hashed, np.searchsorted(owner[order], np.arange(len(words)))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Rows from and to, and their texts (null: empty), about _CHUNK code points together; a longer one comes alone."""
    at, held, size = 0, [], 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        if held and size + len(text) > _CHUNK:
            yield at, i, held
            at, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, len(column), held


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a long text and where they begin, cut behind a space, or else at words' limit."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _CHUNK)
        if end < len(text):
            space = max(text.rfind(" ", at + _CHUNK // 2, end), text.rfind("\n", at + _CHUNK // 2, end))
            end = space + 1 if space > 0 else end
        yield at, text[at:end]
        at = end


@dataclass
class LanguageModel:
    langs: list[str]
    prior: np.ndarray
    table: np.ndarray
    scripts: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """Of each word, what it says against each language (0: nothing)."""
        n, m = len(words.distinct), len(self.langs)
        if n == 0:
            return np.zeros((0, m), np.float32)
        buckets, begins = features(words.distinct, len(self.table))
        found = np.add.reduceat(self.table[buckets], begins, axis=0)
        script = np.zeros(n, np.int64)
        script[words.code] = words.script
        mine = self.scripts[script]
        found = np.where(mine, found, -np.inf)
        best = found.max(axis=1, keepdims=True)
        found = np.where(mine, np.maximum(found - np.where(np.isfinite(best), best, 0), -WORD_LIMIT), -OTHER_SCRIPT)
        found[~mine.any(axis=1)] = 0
        return found.astype(np.float32)[words.code]


def _steps(scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Viterbi over blocks side by side, longest first; state: (blocks, ..., languages), changed in place.

    Yields the step, the blocks' words, each language's state before it, and whether it was switched to.
    """
    for t in range(int(lengths[0]) if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -t, "left"))
        v = state[:active]
        best = v.max(axis=-1, keepdims=True) - SWITCH
        yield t, begins[:active] + t, v, v < best
        e = scores[begins[:active] + t]
        np.maximum(v, best, out=v)
        v += e.reshape(active, *[1] * (v.ndim - 2), -1)


def _blocks(words_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of at most _BLOCK words of texts with so many words: first word, words, text."""
    count = -(-words_of // _BLOCK)
    text = np.repeat(np.arange(len(words_of)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(words_of) - words_of)[text] + within * _BLOCK
    return first, np.minimum(_BLOCK, words_of[text] - within * _BLOCK), text


def _joined(scores: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each block, the best score from each language before it to each at its end."""
    m = scores.shape[1]
    order = np.argsort(-size, kind="stable")
    state = np.full((len(first), m, m), -1e30, np.float64)
    state[:, np.arange(m), np.arange(m)] = 0
    for _ in _steps(scores, first[order], size[order], state):
        pass
    out = np.empty_like(state)
    out[order] = state
    return out


def _labels(scores: np.ndarray, first: np.ndarray, size: np.ndarray, entry: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The languages of all words: each block's path from the scores entry to the language last (-1: the best)."""
    order = np.argsort(-size, kind="stable")
    state, sizes = entry[order].astype(np.float64), size[order]
    before = np.zeros((len(scores), scores.shape[1]), np.int16)
    here = np.arange(scores.shape[1])
    for _, at, v, switched in _steps(scores, first[order], sizes, state):
        before[at] = np.where(switched, v.argmax(axis=-1)[:, None], here)
    label = np.where(last[order] >= 0, last[order], state.argmax(axis=1))
    out = np.zeros(len(scores), np.int64)
    begins = first[order]
    for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        active = int(np.searchsorted(-sizes, -t, "left"))
        out[begins[:active] + t] = label[:active]
        label[:active] = before[begins[:active] + t, label[:active]]
    return out


def _entries(matrices: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one text's blocks: the language before each (of the first: -1), and at the end of each."""
    v, came = entry, []
    for matrix in matrices:
        through = v[:, None] + matrix
        came.append(through.argmax(axis=0))
        v = through.max(axis=0)
    last = np.empty(len(matrices), np.int64)
    at = int(v.argmax())
    for k in range(len(matrices) - 1, -1, -1):
        last[k] = at
        at = came[k][at]
    return np.concatenate([[-1], last[:-1]]), last


def _entry_scores(before: np.ndarray, prior: np.ndarray) -> np.ndarray:
    out = np.full((len(before), len(prior)), -1e30)
    out[before >= 0, before[before >= 0]] = 0
    out[before < 0] = prior
    return out


def paths(scores: np.ndarray, words_of: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The languages of all words of some texts, with so many words each."""
    first, size, text = _blocks(words_of)
    before, last = np.full(len(first), -1), np.full(len(first), -1)
    long = np.bincount(text, minlength=len(words_of))[text] > 1 if len(text) else np.zeros(0, bool)
    if long.any():
        matrices, which = _joined(scores, first[long], size[long]), text[long]
        cuts = np.flatnonzero(np.diff(which)) + 1
        found = [_entries(part, prior) for part in np.split(matrices, cuts)]
        before[long], last[long] = (np.concatenate(x) for x in zip(*found, strict=True))
    return _labels(scores, first, size, _entry_scores(before, prior), last)


@dataclass
class Labelled:
    """Letters and scores by language of the words so labelled, and the spans of some texts."""

    letters: np.ndarray
    against: np.ndarray
    span_text: np.ndarray
    span_begin: np.ndarray
    span_end: np.ndarray
    span_lang: np.ndarray


def _collected(model: LanguageModel, words: Words, scores: np.ndarray, label: np.ndarray, texts: int, shift: int = 0) -> Labelled:
    m = len(model.langs)
    letters = np.bincount(words.owner * m + label, words.letters, texts * m).reshape(texts, m)
    # What the words of each label say of all languages.
    against = np.stack([np.bincount(words.owner * m + label, column, texts * m) for column in scores.T], axis=1)
    new = np.ones(len(label), bool)
    new[1:] = (label[1:] != label[:-1]) | (words.owner[1:] != words.owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(label))[: len(begin)] - 1
    ends = words.begins[end] + words.lengths[end]
    return Labelled(letters, against.reshape(texts, m, m), words.owner[begin], words.begins[begin] + shift, ends + shift, label[begin])


def _long_text(model: LanguageModel, text: str) -> Labelled:
    """A text longer than a chunk, whose parts are scored twice: for the blocks' best scores, and along the path."""

    def parts():
        for at, piece in _pieces(text):
            words = cut_words(*_points([piece]))
            yield at, words, model.word_scores(words)

    sizes, matrices = [], []
    for _, words, scores in parts():
        first, size, _ = _blocks(np.array([len(words.code)]))
        sizes.append(len(first))
        matrices.append(_joined(scores, first, size))
    every = np.concatenate(matrices)
    before, last = _entries(every, model.prior) if len(every) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found, at = [], 0
    for (shift, words, scores), k in zip(parts(), sizes, strict=True):
        first, size, _ = _blocks(np.array([len(words.code)]))
        label = _labels(scores, first, size, _entry_scores(before[at : at + k], model.prior), last[at : at + k])
        found.append(_collected(model, words, scores, label, 1, shift))
        at += k
    begin, end, lang = (np.concatenate([getattr(x, f"span_{name}") for x in found]) for name in ("begin", "end", "lang"))
    # Spans that a cut between parts divides are one.
    new = np.ones(len(lang), bool)
    new[1:] = lang[1:] != lang[:-1]
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(lang)) - 1 if len(lang) else starts
    return Labelled(sum(x.letters for x in found), sum(x.against for x in found), np.zeros(len(starts), np.int64), begin[starts], end[stops], lang[starts])


def label_texts(model: LanguageModel, texts: list[str]) -> Labelled:
    if len(texts) == 1 and len(texts[0]) > _CHUNK:
        return _long_text(model, texts[0])
    points, ends = _points(texts)
    # The places of a text count from its own beginning.
    words = cut_words(points, ends)
    scores = model.word_scores(words)
    label = paths(scores, np.bincount(words.owner, minlength=len(texts)), model.prior)
    words.begins = words.begins - ends[words.owner]
    return _collected(model, words, scores, label, len(texts))


def _predicted(found: Labelled, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score, and whether there are letters."""
    total = found.letters.sum(axis=1)
    best = found.letters.argmax(axis=1)
    rows = np.arange(len(best))
    logs = found.against[rows, best] + prior
    chance = np.exp(logs[rows, best] - np.logaddexp.reduce(logs, axis=1)) if len(best) else np.zeros(0)
    return best, np.where(total > 0, found.letters[rows, best] / np.maximum(total, 1) * chance, 0), total > 0


SPAN = "array<struct<begin: long, end: long, lang: string>>"
_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _labelled(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for a, b, texts in _texts(batch.column("text")):
                part = batch.slice(a, b - a)
                if not model.langs:
                    none = len(texts)
                    columns = [pa.array([UNKNOWN] * none), pa.array(np.zeros(none)), pa.array([[]] * none, _SPAN)]
                else:
                    found = label_texts(model, texts)
                    best, score, any_letter = _predicted(found, model.prior)
                    offsets = np.searchsorted(found.span_text, np.arange(len(texts) + 1)).astype(np.int32)
                    spans = pa.StructArray.from_arrays([pa.array(found.span_begin), pa.array(found.span_end), pa.array(names[found.span_lang], pa.string())], fields=list(_SPAN.value_type))
                    columns = [pa.array(names[np.where(any_letter, best, -1)], pa.string()), pa.array(score), pa.ListArray.from_arrays(offsets, spans)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "spans"])

    return released(rows)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc32_of(doc_id), F.lit(5)) == 0, F.lit(False))


def _counting(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, bucket and n; a script's letters are counted at -1 minus its number."""
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, texts in _texts(batch.column("text")):
                for text, lang in zip(texts, langs[a:b], strict=True):
                    counts = held.setdefault(lang, np.zeros(buckets + len(SCRIPTS) + 1, np.int64))
                    for _, piece in _pieces(text):
                        words = cut_words(*_points([piece]))
                        if len(words.code):
                            hashed, begins = features(words.distinct, buckets)
                            times = np.bincount(words.code, minlength=len(begins))
                            times = np.repeat(times, np.diff(np.append(begins, len(hashed))))
                            counts[:buckets] += np.bincount(hashed, times, buckets).astype(np.int64)
                            counts[buckets:] += np.bincount(words.script, words.letters, len(SCRIPTS) + 1).astype(np.int64)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < buckets, at, buckets - 1 - at)), pa.array(counts[at])], ["lang", "bucket", "n"])

    return released(rows)


def learn(docs: DataFrame) -> LanguageModel:
    """The model for docs (doc_id, text, lang), from rows with a language and a doc_id that is not held out.

    Of a language with more than TRAIN_BYTES of text a share is taken by a hash of doc_id, so that this is the
    expected size; the driver gets one row a language and at most TABLE counts.  Languages without a letter in
    their texts aren't learned; without any, the model knows none.
    """
    usable = docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).collect() if r["n"]}
    if not sizes:
        return LanguageModel([], np.zeros(0), np.zeros((0, 0), np.float32), np.zeros((0, 0), bool))
    buckets = 1 << max(8, min(16, (TABLE // len(sizes)).bit_length() - 1))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, TRAIN_BYTES / n)) for k, n in sizes.items()], "lang string, share double")
    # A row a language.
    sample = usable.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    with arrow_rows(docs.sparkSession, 1000):
        found = sample.select("lang", "text").mapInArrow(_counting(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    row = np.array([number[x] for x in found["lang"].to_pylist()], np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    counts, letters = np.zeros((buckets, len(langs))), np.zeros((len(SCRIPTS) + 1, len(langs)))
    of_text = bucket >= 0
    counts[bucket[of_text], row[of_text]] = n[of_text]
    letters[-1 - bucket[~of_text], row[~of_text]] = n[~of_text]
    table = np.log((counts + _SMOOTH) / (counts.sum(axis=0) + _SMOOTH * buckets)).astype(np.float32)
    total = np.array([sizes[x] for x in langs], float)
    return LanguageModel(langs, np.log(total / total.sum()), table, letters / letters.sum(axis=0) >= SCRIPT_SHARE)


def label(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and spans (code points from begin to before end) of each row of docs (doc_id, text).

    Texts that are null or have no letter are `und` with score 0 and no spans, as are all if the model knows no
    language.  The score is the share of the letters in spans of lang_pred, times how sure their words are of it.
    Repeated rows are labelled alike; further columns are ignored; a long text is read in parts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_labelled(shared), f"doc_id {kind}, lang_pred string, score double, spans {SPAN}")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_spans, learned from docs' own rows that are not held out; ones with
    a null doc_id are neither."""
    return label(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
