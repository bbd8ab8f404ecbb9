"""SMILES as text: encoding of elements with several letters, tokens, ids and legality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks, elements and signs in the order of their ids.  Elements of several letters are
# written with one character each, which is of our own choosing.
SPECIALS = ["[PAD]", "[CLS]", "[SEP]", "[MASK]"]
ELEMENTS = ["F", "H", "I", "B", "C", "N", "O", "P", "S", "Br", "Cl", "Si", "Se", "se", "@@"]
SIGNS = ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "=", "@", "#", "%", "/", "\\", "(", ")", "+", "-", ".", "[", "]"]
ENCODED = {"Br": "R", "Cl": "L", "Si": "X", "Se": "E", "se": "e", "@@": "&"}
TOKENS = [*SPECIALS, *(ENCODED.get(e, e) for e in ELEMENTS), *SIGNS]
VOCABULARY = {t: i for i, t in enumerate(TOKENS)}


def encode(smiles: Column) -> Column:
    for element, letter in ENCODED.items():
        smiles = F.replace(smiles, F.lit(element), F.lit(letter))
    return smiles


def decode(smiles: Column) -> Column:
    """The elements again; marks in square brackets stay, though they have such letters in them."""
    for mark in SPECIALS:
        smiles = F.replace(smiles, F.lit(mark), F.lit(chr(0xE000 + VOCABULARY[mark])))
    for element, letter in reversed(ENCODED.items()):
        smiles = F.replace(smiles, F.lit(letter), F.lit(element))
    for mark in SPECIALS:
        smiles = F.replace(smiles, F.lit(chr(0xE000 + VOCABULARY[mark])), F.lit(mark))
    return smiles


def tokens(smiles: Column) -> Column:
    return F.filter(F.split(encode(smiles), ""), lambda c: c != "")


def ids(smiles: Column, length: int) -> Column:
    """[CLS] tokens [SEP], padded to length; what is too long or has a character without an id is all padding."""
    known = F.create_map(*[F.lit(x) for pair in VOCABULARY.items() for x in pair])
    body = F.concat(F.array(F.lit(1)), F.transform(tokens(smiles), lambda t: F.try_element_at(known, t)), F.array(F.lit(2)))
    padded = F.concat(body, F.array_repeat(F.lit(0), F.greatest(F.lit(0), length - F.size(body))))
    good = (F.size(body) <= length) & F.forall(body, lambda i: i.isNotNull())
    return F.when(good, padded).otherwise(F.array_repeat(F.lit(0), length))


def legal_ids(smiles: Column, length: int, forbidden: list[str]) -> Column:
    """ids and valid, as a struct: a text with a forbidden element, too long or with an unknown character is
    invalid and all padding."""
    from .text import is_legal

    out = F.when(is_legal(smiles, forbidden), ids(smiles, length)).otherwise(F.array_repeat(F.lit(0), length))
    return F.struct(out.alias("ids"), (F.get(out, F.lit(0)) == 1).alias("valid"))


def from_ids(ids: Column, trim: bool = False) -> Column:
    """The text of an array of ids, with the marks in it unless trimmed."""
    text = decode(F.array_join(F.transform(ids, lambda i: F.get(F.array(*map(F.lit, TOKENS)), i)), ""))
    if trim:
        for mark in SPECIALS[:3]:
            text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def heavy_atoms(smiles: Column) -> Column:
    """Number of atoms but hydrogen in a SMILES."""
    return F.regexp_count(smiles, F.lit(r"\[[0-9]*(?:(?!H[\]+\-0-9])(?:[A-Z][a-z]?|[a-z]{1,2}|\*))|(?<!\[)(?<!\[[0-9])(?:Cl|Br|[BCNOPSFI]|[bcnops])(?![^\[]*\])"))
