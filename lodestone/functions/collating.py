"""Column expressions that make training batches of token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reading import padded, truncated
from .tokens import chance, masked


def masked_where(ids: Column, labels: Column, key: Column, mask_id: int, vocabulary: int, seed: int = 0, ignore: int = -100) -> tuple[Column, Column]:
    """ids and labels for given 0/1 places: .8 become mask_id, .1 any id, .1 stay."""
    drawn = lambda i, what: chance(F.pmod(key * 4096 + i, F.lit(1 << 31)), seed + what)
    on = lambda i: F.get(labels, i) == 1
    new = F.transform(ids, lambda x, i: F.when(~on(i) | (drawn(i, 2) >= 0.9), x).when(drawn(i, 2) < 0.8, F.lit(mask_id)).otherwise(F.floor(drawn(i, 3) * vocabulary).cast("int")))
    return new, F.transform(ids, lambda x, i: F.when(on(i), x).otherwise(ignore))


def order_collated(ids: Column, key: Column, mask_id: int, vocabulary: int, specials: list[int], pad_id: int = 0) -> tuple[Column, Column, Column]:
    """ids, labels and attention mask of the sentence-order task: padding isn't masked either; attention is 0 at
    masked places and 1 at all others, padding among them."""
    new, labels = masked(ids, key, mask_id, vocabulary, [*specials, pad_id])
    return new, labels, F.transform(labels, lambda x: (x == -100).cast("int"))


def running_sums(sizes: Column) -> Column:
    """0 and the sums of the first 1, 2, ... sizes."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def chunks(sums: Column, target: Column, key: Column, seed: int = 0, put_back: float | None = None) -> Column:
    """Sentences of a document put together until they have target tokens, as structs first, past, split, random.

    sums are the running_sums of the sentences' sizes.  The last chunk may be shorter.  split is where the
    second part begins, drawn from the inner borders (past for one sentence).  With put_back, random is drawn
    with that chance, and always true for one sentence; the sentences behind split are then left for the next chunk.
    """
    drawn = lambda i, what: chance(F.pmod(key * 4096 + i, F.lit(1 << 31)), seed + what)
    kind = "array<struct<first:int,past:int,split:int,random:boolean>>"
    start = F.struct(F.lit(0).alias("first"), sums.alias("sums"), F.array().cast(kind).alias("out"))

    def step(acc: Column, n: Column) -> Column:
        first, sums = acc["first"], acc["sums"]
        n = F.size(sums) - 1
        long = F.filter(F.sequence(first + 1, F.greatest(n, first + 1)), lambda e: (e <= n) & (F.get(sums, e) - F.get(sums, first) >= target))
        past = F.coalesce(F.get(long, F.lit(0)), n)
        split = F.when(past - first > 1, first + 1 + F.floor(drawn(first, 1) * (past - first - 1)).cast("int")).otherwise(past)
        random = F.lit(False) if put_back is None else (past - first == 1) | (drawn(first, 2) < put_back)
        made = F.struct(first.alias("first"), past.alias("past"), split.alias("split"), random.alias("random"))
        after = F.struct(F.when(random, split).otherwise(past).alias("first"), sums.alias("sums"), F.concat(acc["out"], F.array(made)).alias("out"))
        return F.when(first >= n, acc).otherwise(after)

    return F.aggregate(sums, start, step, lambda acc: acc["out"])


def truncated_at_random(n: Column, m: Column, size: int, key: Column, seed: int = 0) -> Column:
    """How many tokens go from the front and the back of two sequences to have size together: always from the longer
    (the second of equals), from its front as often as a coin says; as a struct front_a, back_a, front_b, back_b."""
    over = F.greatest(F.lit(0), n + m - size)
    gap = F.least(over, F.abs(n - m))
    rest = over - gap
    cut_a = (F.when(n > m, gap).otherwise(0) + F.floor(rest / 2)).cast("int")
    cut_b = (F.when(m > n, gap).otherwise(0) + F.ceil(rest / 2)).cast("int")
    heads = lambda k, what: F.size(F.filter(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: (i <= k) & (chance(F.pmod(key * 4096 + i, F.lit(1 << 31)), seed + what) < 0.5)))
    a, b = heads(cut_a, 3), heads(cut_b, 4)
    return F.struct(a.alias("front_a"), (cut_a - a).alias("back_a"), b.alias("front_b"), (cut_b - b).alias("back_b"))


def seq2seq(source: Column, target: Column, length: int, target_length: int, sep: int, pad_id: int = 0) -> Column:
    """input_ids, attention_mask and labels: both sides cut to their length with sep at the end, and padded."""
    side = lambda x, k: padded(F.concat(F.slice(x, 1, k - 1), F.array(F.lit(sep))), F.lit(k), pad_id)
    a, b = side(source, length), side(target, target_length)
    return F.struct(a["input_ids"].alias("input_ids"), a["attention_mask"].alias("attention_mask"), b["input_ids"].alias("labels"))


def pair_features(a: Column, b: Column, length: int, cls: int, sep: int) -> Column:
    """input_ids, attention_mask and token_type_ids of [CLS] a [SEP] b [SEP], cut longest first and padded."""
    t = truncated(a, b, F.size(a) + F.size(b) + 3 - length)
    ids = F.concat(F.array(F.lit(cls)), t["a"], F.array(F.lit(sep)), t["b"], F.array(F.lit(sep)))
    p = padded(ids, F.lit(length))
    first, second = F.size(t["a"]) + 2, F.size(t["b"]) + 1
    types = F.concat(F.array_repeat(F.lit(0), first), F.array_repeat(F.lit(1), second), F.array_repeat(F.lit(0), F.greatest(F.lit(0), length - first - second)))
    return F.struct(p["input_ids"].alias("input_ids"), p["attention_mask"].alias("attention_mask"), types.alias("token_type_ids"))


def label_id(label: Column, labels: list[str], swap: tuple[int, int] | None = None) -> Column:
    """The place of a label in the list (two of them swapped, for models that were trained so), or null."""
    labels = list(labels)
    if swap:
        labels[swap[0]], labels[swap[1]] = labels[swap[1]], labels[swap[0]]
    at = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(at > 0, (at - 1).cast("int"))


def special_mask(ids: Column, specials: list[int]) -> Column:
    return F.transform(ids, lambda x: x.isin(specials).cast("int"))


def split_on_added(text: Column, added: list[str]) -> Column:
    """The text in parts: added tokens whole, and what stands between them; empty parts go."""
    import re

    ordered = sorted(added, key=lambda t: (-len(t), t))
    pattern = "|".join(re.escape(t) for t in ordered)
    marked = F.regexp_replace(text, f"({pattern})", "\x02$1\x02")
    return F.filter(F.split(marked, "\x02"), lambda p: p != "")


def sequence_lengths(single: int, is_same: bool) -> tuple[int, int]:
    """Length of one sequence without its two marks, and of both together; two of the same task double it."""
    return single - 2, 2 * single if is_same else single


def pair_sample(a: Column, b: Column, same: Column, single: int, cls: int, sep: int) -> Column:
    """input_ids, token_type_ids, same and valid of a sample of one text or two (b null): each text may have single
    tokens less its marks; a longer or empty one makes the row invalid, all zeros."""
    length, whole = sequence_lengths(single, True)
    fits = lambda x: (F.size(x) > 0) & (F.size(x) <= length)
    valid = F.coalesce(fits(a) & (b.isNull() | fits(b)), F.lit(False))
    second = F.coalesce(F.concat(b, F.array(F.lit(sep))), F.slice(a, 1, 0))
    ids = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)), second)
    types = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(second)))
    fill = lambda x: F.concat(x, F.array_repeat(F.lit(0), F.greatest(F.lit(0), whole - F.size(x))))
    zeros = F.array_repeat(F.lit(0), whole)
    return F.struct(F.when(valid, fill(ids)).otherwise(zeros).alias("input_ids"), F.when(valid, fill(types)).otherwise(zeros).alias("token_type_ids"), F.when(valid & b.isNotNull(), same.cast("int")).otherwise(0).alias("same"), valid.alias("valid"))
