"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton over the vocabulary enumerates the matches that end at each character;
dynamic programming carries the best score of each prefix and the number of its pieces.  Ties go as
in the tokenizer: the candidate that starts first, thus the longest, is kept, and a later one must
score strictly more; the unknown character comes last.  Runs of unknown characters are one piece,
or one piece a UTF-8 byte with byte fallback.

White space has been turned into word marks, and no piece crosses a word's beginning, so a word is
counted once a worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: The unknown character scores this much less than the least of the vocabulary.
UNKNOWN_PENALTY = 10.0
REMEMBERED = 600_000
_COUNTERS: dict = {}


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model by id; their scores by Zipf's law of their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 1)) for i in range(model.get_piece_size())]


class Counter(dict):
    """word (with its mark) -> number of pieces."""

    def __init__(self, vocabulary: list[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = True):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unk_id))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown_piece = vocabulary[unk_id][0]
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.bytes_too = byte_fallback and {f"<0x{b:02X}>" for b in range(256)} <= {piece for piece, _ in vocabulary}
        self.missed = 0

    def viterbi(self, word: str) -> int:
        n = len(word)
        best, start, unk = [-math.inf] * (n + 1), [-1] * (n + 1), [False] * (n + 1)
        pieces, run = [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at = 0

        def settle(end: int) -> None:
            """Ends at this character are complete but for the unknown character."""
            if word[end - 1] not in self.single:
                score = best[end - 1] + self.unknown
                if start[end] < 0 or score > best[end]:
                    best[end], start[end], unk[end] = score, end - 1, True
            a = start[end]
            if not unk[end]:
                pieces[end] = pieces[a] + 1
            else:
                run[end] = run[a] if unk[a] else a
                text = word[run[end] : end]
                pieces[end] = pieces[run[end]] + (len(text.encode()) if self.bytes_too and text != self.unknown_piece else 1)

        for last, (length, score, is_unk) in self.automaton.iter(word):
            end = last + 1
            while at < end - 1:
                at += 1
                settle(at)
            score += best[end - length]
            if start[end] < 0 or score > best[end]:
                best[end], start[end], unk[end] = score, end - length, is_unk
        while at < n:
            at += 1
            settle(at)
        return pieces[n]

    def __missing__(self, word: str) -> int:
        found = self.viterbi(MARK + word)
        if len(self) < REMEMBERED:
            if len(word) < 64:
                self[word] = found
        else:
            self.missed += 1
            if self.missed > 8 * REMEMBERED:
                self.clear()
                self.missed = 0
        return found

    def count(self, text: str | None) -> int:
        """Pieces of a text: spaces become marks, one is put before the text, words begin at marks."""
        if not text:
            return 0
        if text[0] in (" ", MARK):
            text = text[1:]
        return sum(map(self.__getitem__, (text.replace(MARK, " ") if MARK in text else text).split(" ")))


def _counted(path: str, byte_fallback: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = path, byte_fallback
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(piece_vocabulary(path), 0, byte_fallback)
        for batch in batches:
            counts = [_COUNTERS[key].count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return rows


def count_tokens(docs: DataFrame, model_path: str, byte_fallback: bool = True) -> DataFrame:
    """doc_id and n_tokens for each row of docs (doc_id, text); further columns are ignored.

    Null and empty texts have no token; repeated rows and null doc_ids are counted like any other,
    and an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counted(model_path, byte_fallback), f"doc_id {kind}, n_tokens bigint")
