"""Token arrays: assembling, padding, truncating, masking and cutting them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import pad

#: Multiplier and modulus of the portable hash, which any SQL engine can follow.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def portable_hash(key: Column, seed: int = 0) -> Column:
    """A number below 2 ** 32 from a key under 2 ** 31; the same everywhere."""
    first = F.pmod((key + seed) * F.lit(MULTIPLIER), F.lit(MODULUS))
    return F.pmod(F.shiftrightunsigned(first, 7) * F.lit(2246822519 % (1 << 31)) + first, F.lit(MODULUS))


def chance(key: Column, seed: int = 0) -> Column:
    """portable_hash as a number from 0 to 1."""
    return portable_hash(key, seed) / float(MODULUS)


def truncated_pair(a: Column, b: Column, size: int) -> tuple[Column, Column]:
    """Both shortened at the end to size together, always the longer one; b where they are equally long."""
    n, m = F.size(a), F.size(b)
    over = F.greatest(F.lit(0), n + m - size)
    # First the longer one comes down to the other, then both in turn, b first.
    gap = F.abs(n - m)
    first = F.least(over, gap)
    rest = over - first
    cut_a = F.when(n > m, first).otherwise(0) + F.floor(rest / 2)
    cut_b = F.when(m > n, first).otherwise(0) + F.ceil(rest / 2)
    return F.slice(a, F.lit(1), F.greatest(F.lit(0), n - cut_a).cast("int")), F.slice(b, F.lit(1), F.greatest(F.lit(0), m - cut_b).cast("int"))


def assembled(a: Column, b: Column | None, cls, sep) -> tuple[Column, Column]:
    """[CLS] a [SEP] (b [SEP]) and the segment of each token."""
    one = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)))
    first = F.array_repeat(F.lit(0), F.size(a) + 2)
    if b is None:
        return one, first
    return F.concat(one, b, F.array(F.lit(sep))), F.concat(first, F.array_repeat(F.lit(1), F.size(b) + 1))


def features(ids: Column, types: Column, size: int, pad_id: int = 0) -> dict[str, Column]:
    return {"input_ids": pad(ids, size, pad_id), "token_type_ids": pad(types, size, 0), "attention_mask": pad(F.transform(ids, lambda _: F.lit(1)), size, 0)}


def unmasked(ids: Column, labels: Column, ignore: int = -1) -> Column:
    return F.zip_with(ids, labels, lambda i, label: F.when(label != ignore, label).otherwise(i))


def masked(ids: Column, key: Column, mask_id: int, vocabulary: int, specials: list[int], seed: int = 0, share: float = 0.15, ignore: int = -100) -> tuple[Column, Column]:
    """Ids with a share masked (of these .8 by mask_id, .1 by any id, .1 left), and labels.

    Chances come from the hash of key * 4096 + place, so a row is masked the same way everywhere.
    """

    def drawn(i: Column, what: int) -> Column:
        return chance(F.pmod(key * 4096 + i, F.lit(1 << 31)), seed + what)

    def chosen(x: Column, i: Column) -> Column:
        return ~x.isin(specials) & (drawn(i, 1) < share)

    new = F.transform(ids, lambda x, i: F.when(~chosen(x, i) | (drawn(i, 2) >= 0.9), x).when(drawn(i, 2) < 0.8, F.lit(mask_id)).otherwise(F.floor(drawn(i, 3) * vocabulary).cast("int")))
    labels = F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(ignore))
    return new, labels


def blocks(ids: Column, size: int) -> Column:
    """Full blocks only; what is left over is dropped."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1)), F.lit(size)), lambda s: s + size - 1 <= F.size(ids))
    return F.transform(starts, lambda s: F.slice(ids, s, F.lit(size)))


def spans(ids: Column, length: int, stride: int) -> Column:
    """(start, tokens) of overlapping spans; the first that reaches the end is the last."""
    n = F.size(ids)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil((n - length) / stride) * stride).cast("int")), F.lit(stride))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(ids, s + 1, F.lit(length)).alias("tokens")))


def ngrams(ids: Column, n: int) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), lambda s: s + n - 1 <= F.size(ids))
    return F.transform(starts, lambda s: F.slice(ids, s, F.lit(n)))


def rounded_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")
