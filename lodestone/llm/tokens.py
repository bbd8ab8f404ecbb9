"""Token ids of whole texts by the tokenizers library, encoding each new word only once a worker.

The two pre-tokenisers supported here never let a token cross certain places, so a text may be cut
there and the pieces encoded one by one:

* byte-level BPE: before a single space that has no white space on both of its sides, around a line
  feed that has none on either, and after the letters that a piece begins with;
* word BPE: at spaces and line feeds (white space is dropped), and after a piece's first letters
  where an ASCII character follows (which never combines with what stands before it).  It lower-cases
  character by character, which is the lower case of the whole text within the Latin blocks.

A text with longer runs of white space, where the first rule doesn't hold, is encoded as it stands.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import regex

BYTE_LEVEL, WORD = "byte_level", "word"
#: Most words a worker remembers; see _Ids for what happens beyond it.
REMEMBERED = 600_000
_BARE = re.compile(r"\s (?:\s|$)")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_LETTERS = regex.compile(r" ?\p{L}+")
_ENCODERS: dict[tuple[str, str, int | None], Encoder] = {}


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in for every byte value in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _byte_alphabet()


class _Ids(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; lead is put before the piece.

    Words met early are the frequent ones: when full, the memory takes no more words, until it has
    missed several times its size.
    """

    def __init__(self, encode, letters, lead: str, most: int | None):
        super().__init__()
        self.encode, self.letters, self.lead, self.missed = encode, letters, lead, 0
        self.most = REMEMBERED if most is None else most

    def __missing__(self, piece: str) -> bytes:
        whole = self.lead + piece
        if "İ" not in whole and 0 < (line := piece.find("\n")) < len(piece) - 1 and not piece[line - 1].isspace() and not piece[line + 1].isspace():
            return self[piece[:line]] + self.rest["\n"] + self.rest[piece[line + 1 :]]
        # The lower case of this one letter ends in a mark that isn't a letter.
        m = _LETTERS.match(whole) if "İ" not in whole else None
        if m is None:
            found = self.encode(whole)
        elif (at := m.end()) == len(whole):
            found = self.letters(whole)
        elif whole[at].isascii():
            cut = at - len(self.lead)
            found = self[piece[:cut]] + self.rest[piece[cut:]]
        else:
            found = self.encode(whole)
        if len(self) < self.most:
            if len(piece) < 64:
                self[piece] = found
        else:
            self.missed += 1
            if self.missed > 8 * self.most:
                self.clear()
                self.missed = 0
        return found


class Encoder:
    def __init__(self, path: str, kind: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.byte_level = kind == BYTE_LEVEL
        letters = self._byte_letters if self.byte_level else self._word_letters
        self.first = _Ids(self._encode, letters, "", remembered)
        self.after_space = _Ids(self._encode, letters, " ", remembered) if self.byte_level else self.first
        self.first.rest = self.after_space.rest = self.first

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _byte_letters(self, word: str) -> bytes:
        """Ids of one pre-token: the pre-tokeniser has nothing to do, so the model is asked directly."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize("".join(map(_ALPHABET.__getitem__, word.encode())))]).tobytes()

    def _word_letters(self, word: str) -> bytes:
        """The same for word vocabularies, whose normaliser only lower-cases letters of Latin blocks."""
        if not word.isascii() and max(word) > "\u024f":
            return self._encode(word)
        word = unicodedata.normalize("NFC", word).lower()
        return array("I", [t.id for t in self.tokenizer.model.tokenize("".join(map(_ALPHABET.__getitem__, word.encode())))]).tobytes() if word.isalpha() else self._encode(word)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.byte_level:
            if text.isascii() or not _BEYOND_LATIN.search(text):
                text = text.lower()
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        if _BARE.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        return (self.first[first] if first else b"") + b"".join(map(self.after_space.__getitem__, rest))


def encoder(path: str, kind: str, remembered: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; its memory, of REMEMBERED words unless fewer are asked for, lasts as
    long as the worker."""
    key = (path, kind, remembered)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
