"""The thin queries over whole tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, interaction, langid
from .ann import nearest
from .chat import format_chat, read_back, with_control_strings
from .common import new_path, table
from .fingerprints import edited_fingerprints
from .jaccard import jaccard_components
from .mixing import Mix, mixed, words
from .packing import pack
from .pii import pseudonymise
from .quality import classify
from .token_files import read_digests, write_tokens
from .tokens import vocabulary_path
from .unigram import count_tokens

#: A production run takes its own from a secret store.
SURROGATE_KEY = "surrogates"

#: Domains of the sources, and target weights of domains and languages; sources of a language are equal.
DOMAINS = {"src0": "web"} | {f"src{i}": "books" for i in range(1, 8)} | {f"src{i}": "forums" for i in range(8, 14)}
WEIGHTS = {"domain": {"web": 0.3, "books": 0.4, "forums": 0.2, "other": 0.1}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
MIX = Mix(WEIGHTS, DOMAINS, budget_share=1.0, max_epochs=2)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_chat(with_control_strings(table(spark, sf_dir, "conversations"))))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"))
    return read_digests(spark, path)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixed(table(spark, sf_dir, "documents"), MIX)
    return chosen.select("doc_id", "lang", "source", "epoch", words(F.col("text")).alias("n_tokens"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_source_mixing": op8_source_mixing,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_language_id": op11_language_id,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_interaction": op13_filter_interaction,
}

ORACLE_SQL: dict[str, str] = {
    "op12_source_divergence": divergence.ORACLE,
    "op13_filter_interaction": interaction.ORACLE,
}
