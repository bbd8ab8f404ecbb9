"""Word shingles as 64-bit hashes, for whole Arrow batches at a time.

A text is lower-cased on A-Z only and cut into words ``[^\\x20\\x09-\\x0D]+``.  Its set holds the
hashes of its distinct five-word shingles; a text of one to four words has one shingle, the whole
sequence; a null or wordless text has the empty set.  Everything works on the UTF-8 bytes: white
space and A-Z are single bytes there, so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

K = 5
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(int(_RNG.integers(2**62, 2**63)) | 1)
_Q = np.uint64(int(_RNG.integers(2**62, 2**63)) | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HASH_OF_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 18
_POWERS = np.ones(0, np.uint64), np.ones(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, _CHUNK)
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p)]), dtype=np.uint64) for p in (_P, _P_INV))
    return _POWERS


def _chunk_sets(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; text i is data[ends[i]:ends[i + 1]]."""
    n_docs, n = len(ends) - 1, len(data)
    if n == 0:
        yield from (np.zeros(0, np.uint64) for _ in range(n_docs))
        return
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    starts_at = ends[:-1][ends[:-1] < ends[1:]]
    before[starts_at] = True
    start = np.flatnonzero(~space & before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[ends[1:][ends[:-1] < ends[1:]] - 1] = True
    stop = np.flatnonzero(~space & after) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_HASH_OF_BYTE[data] * up[:n], out=total[1:])
    word = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, ends)
    grams = np.zeros(max(0, len(word) - K + 1), np.uint64)
    for k in range(K):
        grams = grams * _Q + word[k : k + len(grams)]
    grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= K:
            s = np.sort(grams[a : b - K + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = h * _Q + w
            yield mix(np.array([h ^ np.uint64(0x5DEECE66D)]))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of every text of an Arrow string array, in order; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + _CHUNK, "right")) - 1)
            yield from _chunk_sets(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            i = j


def digest(s: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())
