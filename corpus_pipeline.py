"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Documents that the quality classifier rejects go, one document of each group of near duplicates
stays, personal data are replaced, sources are mixed to target weights, and what is chosen is packed
into training sequences.  All but the last stage return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table, and keeps
further columns, whatever their names, but for epoch, which mixing drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, written
from lodestone.llm.jaccard import one_of_each
from lodestone.llm.mixing import Mix, mixed
from lodestone.llm.packing import pack
from lodestone.llm.pii import pseudonymise
from lodestone.llm.quality import accepted
from lodestone.llm.queries import DOMAINS, SURROGATE_KEY, WEIGHTS
from lodestone.llm.tokens import vocabulary_path

#: Words that packing's workers remember: fewer than by default, since they share their executors with the other stages' workers.
REMEMBERED = 250_000
#: Four fifths of the words, no document more than once.
MIX = Mix(WEIGHTS, DOMAINS, budget_share=0.8, max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents predicted to be good; null and empty texts are scored too, repeated rows stay or go together."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the smallest doc_id; texts without words all stay,
    repeated rows don't."""
    return one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates in text, and n_chars after it; null texts stay null, with no n_chars."""
    replaced = pseudonymise(docs, SURROGATE_KEY, count=None)
    return replaced.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else replaced


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen by domain, language and source, each once; null languages and sources are leaves of
    their own, null texts cost nothing."""
    return mixed(docs, MIX).drop("epoch")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its place; null texts are empty, repeated rows are packed as often as they come."""
    return pack(docs, vocabulary_path("byte_bpe_50k.json"), remembered=REMEMBERED)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Neither the learned classifier nor the tokenizer can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
