"""Text normalisation and cutting as column expressions."""

from __future__ import annotations

import re
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Full-width and CJK punctuation, and what stands for each.
WIDE = "，、：？！（）；「」“”’‘…－０１２３４５６７８９"
NARROW = ",,:?!();\"\"\"\"''.-0123456789"
#: Dashes, an ellipsis and an accent, and what stands for each; runs of marks that get space around them.
STANDARD = {"—": "-", "–": "-", "―": "-", "…": "...", "´": "'"}
SPACED_RUNS = r"(-+|~+|!+|\"+|;+|\?+|\++|,+|\)+|\(+|\\+|/+|\*+|\[+|\]+|\}+|\{+|\|+|_+)"
#: Pairs of old and new text of tweets, one after the other: each works on what the one before has left.
TWEET_PAIRS = [
    ("cannot ", "can not "), ("n't ", " n't "), ("n 't ", " n't "), ("ca n't", "can't"), ("ai n't", "ain't"), ("'m ", " 'm "), ("'re ", " 're "), ("'s ", " 's "), ("'ll ", " 'll "),
    ("'d ", " 'd "), ("'ve ", " 've "), (" p . m .", "  p.m."), (" p . m ", " p.m "), (" a . m .", " a.m."), (" a . m ", " a.m "),
]
#: A handle: twenty characters that no @ follows, or fewer that end before one.
HANDLE = r"(?<![A-Za-z0-9_!@#$%&*])@(?:[A-Za-z0-9_]{20}(?!@)|[A-Za-z0-9_]{1,19}(?![A-Za-z0-9_]*@))"
#: Entities whose character isn't the one of their published code point: a plain space, and the one of XML.
ENTITIES = {**{f"&{name};": chr(code) for name, code in name2codepoint.items()}, "&nbsp;": " ", "&apos;": "'"}


def normalize_answer(s: Column) -> Column:
    """Lower case without ASCII punctuation, articles and surplus space."""
    words = whitespace_tokens(F.translate(F.lower(s), PUNCTUATION, ""))
    return F.array_join(F.filter(words, lambda w: ~w.isin("a", "an", "the")), " ")


def whitespace_tokens(s: Column) -> Column:
    """Runs of other than white space; none in an empty text."""
    return F.regexp_extract_all(s, F.lit(r"([^ \t-\r]+)"), F.lit(1))


def _plain() -> dict[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks with accents -> the letter they decompose into."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x590), *range(0x1E00, 0x2000)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            out[c] = base
    return out


_PLAIN = _plain()


def strip_accents(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, "".join(_PLAIN), "".join(_PLAIN.values())), r"\p{Mn}", "")


def basic_tokens(s: Column, lower: bool = True) -> Column:
    """Words and single punctuation marks (of ASCII and of any other script); control characters go, CJK
    characters stand alone; in lower case accents go too."""
    s = F.regexp_replace(s, r"[\x00-\x08\x0e-\x1f\x7f]", "")
    s = strip_accents(F.lower(s)) if lower else s
    return F.regexp_extract_all(s, F.lit(r"([!-/:-@\[-`{-~\p{P}]|[一-鿿㐀-䶿]|[^ \t-\r\p{Zs}!-/:-@\[-`{-~\p{P}一-鿿㐀-䶿]+)"), F.lit(1))


def clean_up_tokenization(s: Column) -> Column:
    for old, new in ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def text_standardize(s: Column) -> Column:
    """Dashes, ellipses and accents to ASCII; space around runs of punctuation and line feeds; no surplus space."""
    for old, new in STANDARD.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, SPACED_RUNS, " $1 ")
    s = F.regexp_replace(s, r"[ \t\r\f\x0b]*\n[ \t\r\f\x0b]*", " \n ")
    return F.regexp_replace(F.regexp_replace(s, r"[^\S\n]+", " "), r"^[ \t-\r]+|[ \t-\r]+$", "")


def tokenize_numbers(s: Column) -> Column:
    """5,000 becomes 5 @,@ 000 and 1.73 becomes 1 @.@ 73."""
    return F.regexp_replace(F.regexp_replace(s, r"(\d),(?=\d)", "$1 @,@ "), r"(\d)\.(?=\d)", "$1 @.@ ")


def detokenize_numbers(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit(" @,@ "), F.lit(",")), F.lit(" @.@ "), F.lit("."))


def reduce_lengthening(s: Column) -> Column:
    """No character more than three times in a row."""
    return F.regexp_replace(s, r"(?s)(.)\1{2,}", "$1$1$1")


def remove_handles(s: Column) -> Column:
    return F.regexp_replace(s, HANDLE, " ")


def normalize_tweet_token(t: Column) -> Column:
    low = F.lower(t)
    return F.when(F.startswith(t, F.lit("@")), "@USER").when(low.startswith("http") | low.startswith("www"), "HTTPURL").when(t == "’", "'").when(t == "…", "...").otherwise(t)


def normalize_tweet(s: Column) -> Column:
    """Handles and addresses by name; contractions cut off; a.m. and p.m. put together."""
    s = F.array_join(F.transform(whitespace_tokens(F.replace(F.replace(s, F.lit("’"), F.lit("'")), F.lit("…"), F.lit("..."))), normalize_tweet_token), " ")
    for old, new in TWEET_PAIRS:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(s, r"[ \t-\r]+", " "))


def html_entities(s: Column) -> Column:
    """The named entities of HTML and the numbered ones; what is made of one isn't decoded again, unknown names stay."""
    pattern = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
    between, found = F.split(s, pattern), F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        number = F.conv(digits, 16, 16)
        number = F.when(p.rlike("^&#[xX]"), number).otherwise(F.conv(digits, 10, 16))
        code = F.conv(number, 16, 10).cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")
        return F.when(p.rlike("^&#[xX]?[0-9a-fA-F]+;$") & valid, char).otherwise(F.coalesce(F.try_element_at(known, p), p))

    return F.array_join(F.zip_with(between, F.transform(found, one), lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")


def narrow_punctuation(s: Column) -> Column:
    s = F.regexp_replace(s, "。[ \t-\r]*", ". ")
    return F.translate(s, WIDE, NARROW)


def drop_control(s: Column) -> Column:
    return F.regexp_replace(s, r"[\x00-\x1f\x7f-\x9f]", "")


def context_string(title: Column, text: Column, query: Column, prefix: str = "", title_sep: str = " / ", doc_sep: str = " // ") -> Column:
    """A retrieved passage before its question; a quote at either end of the title goes."""
    title = F.regexp_replace(title, '^"|"$', "")
    return F.replace(F.concat(F.lit(prefix), title, F.lit(title_sep), text, F.lit(doc_sep), query), F.lit("  "), F.lit(" "))


def is_legal(smiles: Column, forbidden: list[str]) -> Column:
    """None of the forbidden elements is in the text."""
    out = F.lit(True)
    for f in forbidden:
        out = out & ~F.contains(smiles, F.lit(f))
    return out


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    distinct = F.array_intersect(a, b)
    least = F.transform(distinct, lambda t: F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.aggregate(least, F.lit(0), lambda s, x: s + x)


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_answer(pred) == normalize_answer(gold)).cast("int")


def token_f1(pred: Column, gold: Column) -> Column:
    """Token F1 of normalised answers; if either has no token, 1 only if both have none."""
    p, g = whitespace_tokens(normalize_answer(pred)), whitespace_tokens(normalize_answer(gold))
    same = common_tokens(p, g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def label_list(labels: Column) -> Column:
    """The labels that a text lists by commas, stripped."""
    return F.transform(F.split(labels, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def hypotheses(labels: Column, template: str) -> Column:
    """The template with each label in its first ``{}``; ``{{`` and ``}}`` are braces.  One without a place for it is an error."""
    parts = re.split(r"(?<!\{)\{\}(?!\})", template)
    if len(parts) < 2:
        raise ValueError(f"the template {template!r} has no place for a label")
    before, after = (x.replace("{{", "{").replace("}}", "}") for x in (parts[0], "{}".join(parts[1:])))
    return F.transform(labels, lambda x: F.concat(F.lit(before), x, F.lit(after)))
