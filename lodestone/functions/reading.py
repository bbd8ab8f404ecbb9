"""Column expressions of extractive question answering: offsets, spans, truncation and padding of pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basic_tokens, whitespace_tokens

#: White space between the words of a context, among it the narrow no-break space.
GAPS = "[^ \t\r\n ]+"


def context_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({GAPS})"), F.lit(1))


def word_at(text: Column, char: Column) -> Column:
    """The number of the word that a character is in, or that precedes it if it is white space (-1 before all)."""
    return F.regexp_count(F.substring(text, F.lit(1), char + 1), F.lit(GAPS)) - 1


def answer_words(text: Column, start: Column, answer: Column) -> Column:
    """First and last word of an answer that begins at a character, as a struct."""
    last = F.least(start + F.char_length(answer) - 1, F.char_length(text) - 1)
    return F.struct(word_at(text, start).alias("first"), word_at(text, last).alias("last"))


def holds_answer(text: Column, first: Column, last: Column, answer: Column) -> Column:
    """Whether the words from first to last hold the answer, white space apart."""
    found = F.array_join(F.slice(context_words(text), first + 1, F.greatest(last - first + 1, F.lit(0))), " ")
    return F.contains(found, F.array_join(whitespace_tokens(answer), " "))


def improved_span(tokens: Column, first: Column, last: Column, answer: Column) -> Column:
    """The first sub-span (earliest start, then latest end) whose tokens, joined by spaces, are the answer; else the span."""
    inside = F.flatten(F.transform(F.sequence(first, last), lambda s: F.transform(F.sequence(last, s), lambda e: F.struct(s.alias("first"), e.alias("last")))))
    exact = F.filter(inside, lambda x: F.array_join(F.slice(tokens, x["first"] + 1, x["last"] - x["first"] + 1), " ") == answer)
    return F.coalesce(F.get(exact, F.lit(0)), F.struct(first.alias("first"), last.alias("last")))


def span_features(question: Column, context: Column, first: Column, last: Column, length: int, stride: int, cls, sep) -> Column:
    """[CLS] question [SEP] part of the context [SEP] for overlapping parts, as structs.

    p_mask is 1 where no answer can be; start and end are those of the answer (context tokens first to
    last; null if there is none) within the part, or 0 (of [CLS]) and is_impossible if it isn't whole in it.
    """
    offset, n = F.size(question) + 2, F.size(context)
    room = length - F.size(question) - 3
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil((n - room) / stride) * stride).cast("int")), F.lit(stride))

    def feature(s: Column) -> Column:
        part = F.slice(context, s + 1, room)
        inside = F.coalesce((first >= s) & (last < s + F.size(part)), F.lit(False))
        at = lambda x: F.when(inside, x - s + offset).otherwise(0)
        ids = F.concat(F.array(F.lit(cls)), question, F.array(F.lit(sep)), part, F.array(F.lit(sep)))
        mask = F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), F.size(question) + 1), F.array_repeat(F.lit(0), F.size(part)), F.array(F.lit(1)))
        types = F.concat(F.array_repeat(F.lit(0), offset), F.array_repeat(F.lit(1), F.size(part) + 1))
        return F.struct(s.alias("doc_start"), ids.alias("input_ids"), types.alias("token_type_ids"), mask.alias("p_mask"), at(first).alias("start"), at(last).alias("end"), (~inside).alias("is_impossible"))

    return F.transform(starts, feature)


def final_text(pred: Column, original: Column, lower: bool = True) -> Column:
    """The part of the original text that a tokenised answer stands for, by counting characters that aren't
    spaces; the original where that can't be told."""
    tokens = F.array_join(basic_tokens(original, lower), " ")
    at = F.instr(tokens, pred)
    bare = lambda s: F.char_length(F.replace(s, F.lit(" "), F.lit("")))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(original), F.lit(1))), lambda i: F.substring(original, i, F.lit(1)) != " ")
    before = bare(F.substring(tokens, F.lit(1), at - 1))
    first, last = F.get(places, before), F.get(places, before + bare(pred) - 1)
    found = F.substring(original, first, last - first + 1)
    return F.when((at == 0) | (bare(tokens) != bare(original)) | first.isNull() | last.isNull(), original).otherwise(found)


def span_to_answer(text: Column, pieces: Column, start: Column, end: Column) -> Column:
    """answer, start and end character of the words (between single spaces) whose first token is from start to
    end; pieces holds how many tokens each word has."""
    words = F.split(text, " ")
    before = lambda a, i: F.aggregate(F.slice(a, F.lit(1), i), F.lit(0), lambda s, x: s + x)
    sizes = F.transform(words, lambda w: F.char_length(w) + 1)
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), before(pieces, i).alias("token"), before(sizes, i).alias("at")))
    inside = F.filter(placed, lambda x: (x["token"] >= start) & (x["token"] <= end))
    first = F.get(F.filter(inside, lambda x: x["token"] == start), F.lit(0))["at"]
    last = F.filter(inside, lambda x: x["token"] == end)
    last = F.get(F.transform(last, lambda x: x["at"] + F.char_length(x["word"])), F.size(last) - 1)
    return F.struct(F.array_join(F.transform(inside, lambda x: x["word"]), " ").alias("answer"), F.coalesce(first, F.lit(0)).alias("start"), F.least(F.char_length(text), F.coalesce(last, F.lit(0))).alias("end"))


def truncated(a: Column, b: Column, remove: Column, strategy: str = "longest_first", stride: int = 0) -> Column:
    """a, b and the overflow after remove tokens are taken off the end, as a struct.

    longest_first takes each from the longer one, from b if they are equally long; only_first and
    only_second leave a sequence alone that isn't longer than what would go.  The overflow begins stride
    tokens before what is cut; under longest_first the tokens follow each other as they go.
    """
    n, m = F.size(a), F.size(b)
    remove = F.greatest(F.lit(0), remove)
    cut = lambda x, k: F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - k))
    tail = lambda x, k: F.slice(x, F.size(x) - F.least(F.size(x), k) + 1, F.least(F.size(x), k))
    out = lambda x, y, over: F.struct(x.alias("a"), y.alias("b"), over.alias("overflow"))
    none = F.slice(a, 1, 0)
    if strategy == "do_not_truncate":
        return out(a, b, none)
    if strategy == "only_first":
        return F.when((remove > 0) & (n > remove), out(cut(a, remove), b, tail(a, remove + stride))).otherwise(out(a, b, none))
    if strategy == "only_second":
        return F.when((remove > 0) & (m > remove), out(a, cut(b, remove), tail(b, remove + stride))).otherwise(out(a, b, none))
    if strategy != "longest_first":
        raise ValueError(strategy)
    gap = F.least(remove, F.abs(n - m))
    rest = remove - gap
    from_a = F.when(n > m, gap).otherwise(0) + F.floor(rest / 2).cast("int")
    from_b = F.when(m > n, gap).otherwise(0) + F.ceil(rest / 2).cast("int")

    def gone(i: Column) -> Column:
        # Of the tokens after the gap, those with even numbers come from b.
        k = i - gap
        of_a = F.when(k < 0, n > m).otherwise(F.pmod(k, F.lit(2)) == 1)
        at_a = n - F.when(k < 0, i).otherwise(F.when(n > m, gap).otherwise(0) + F.floor(k / 2))
        at_b = m - F.when(k < 0, i).otherwise(F.when(m > n, gap).otherwise(0) + F.floor(k / 2))
        return F.when(of_a, F.get(a, (at_a - 1).cast("int"))).otherwise(F.get(b, (at_b - 1).cast("int")))

    first_a = F.when(gap > 0, n > m).otherwise(F.lit(False))
    lead = F.when(remove == 0, none).when(first_a, tail(a, F.lit(stride + 1))).otherwise(tail(b, F.lit(stride + 1)))
    later = F.when(remove > 1, F.transform(F.sequence(F.lit(1), F.greatest(remove - 1, F.lit(1))), gone)).otherwise(none)
    return out(cut(a, from_a), cut(b, from_b), F.concat(lead, later))


def padded(ids: Column, size: Column, pad_id: int = 0, left: bool = False, multiple: int = 1) -> Column:
    """ids filled up to size, rounded up to a multiple, with attention_mask and special_tokens_mask (1 on padding), as a struct."""
    size = (F.ceil(size / multiple) * multiple).cast("int")
    fill = F.greatest(F.lit(0), size - F.size(ids))
    put = lambda v, x: F.concat(F.array_repeat(F.lit(x), fill), v) if left else F.concat(v, F.array_repeat(F.lit(x), fill))
    return F.struct(put(ids, pad_id).alias("input_ids"), put(F.transform(ids, lambda _: F.lit(1)), 0).alias("attention_mask"), put(F.transform(ids, lambda _: F.lit(0)), 1).alias("special_tokens_mask"))


def token_offsets(text: Column) -> Column:
    """(start, end) characters of the words of a text, end exclusive."""
    words = context_words(text)
    start = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        at = F.instr(F.substring(text, acc["from"], F.char_length(text)), w) + acc["from"] - 1
        return F.struct((at + F.char_length(w)).alias("from"), F.concat(acc["out"], F.array(F.struct((at - 1).alias("start"), (at - 1 + F.char_length(w)).alias("end")))).alias("out"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def char_to_token(offsets: Column, char: Column) -> Column:
    """The token that a character is in, null between tokens."""
    inside = F.filter(F.transform(offsets, lambda o, i: F.struct(i.alias("i"), o["start"].alias("start"), o["end"].alias("end"))), lambda o: (o["start"] <= char) & (char < o["end"]))
    return F.get(inside, F.lit(0))["i"]


def token_to_chars(offsets: Column, token: Column) -> Column:
    return F.get(offsets, token)


def word_to_tokens(word_ids: Column, word: Column) -> Column:
    """First token of a word and the one after its last, as a struct; null if it has none."""
    first = F.array_position(word_ids, word) - 1
    return F.when(first >= 0, F.struct(first.cast("int").alias("start"), (first + F.size(F.filter(word_ids, lambda x: x == word))).cast("int").alias("end")))


def token_to_word(word_ids: Column, token: Column) -> Column:
    """The word that a token is of, null for marks; tokens below 0 count from the end."""
    return F.get(word_ids, F.when(token < 0, F.size(word_ids) + token).otherwise(token))


def word_to_chars(offsets: Column, word_ids: Column, word: Column) -> Column:
    """From the first character of a word's first token to the end of its last, as a struct; null if it has none."""
    span = word_to_tokens(word_ids, word)
    return F.when(span.isNotNull(), F.struct(F.get(offsets, span["start"])["start"].alias("start"), F.get(offsets, span["end"] - 1)["end"].alias("end")))


def char_to_word(offsets: Column, word_ids: Column, char: Column) -> Column:
    """The word that a character is in, null between tokens."""
    return token_to_word(word_ids, char_to_token(offsets, char))
