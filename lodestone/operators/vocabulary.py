"""Vocabularies of token columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def token_counts(rows: DataFrame, tokens: str) -> DataFrame:
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def vocabulary(rows: DataFrame, tokens: str, specials: list[str], max_size: int, min_freq: int = 1) -> DataFrame:
    """token, cnt, id: the specials first (without a count), then the most frequent tokens, ties by token.

    Only the top max_size counts are numbered, by a top-k that keeps no more than that in a task.
    """
    top = token_counts(rows, tokens).where((F.col("cnt") >= min_freq) & ~F.col("token").isin(specials)).orderBy(F.desc("cnt"), "token").limit(max_size)
    numbered = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("cnt"), "token")) + len(specials) - 1)
    first = rows.sparkSession.createDataFrame([(t, None, i) for i, t in enumerate(specials)], "token string, cnt bigint, id int")
    return first.unionByName(numbered.select("token", "cnt", F.col("id").cast("int").alias("id")))


def encoded(rows: DataFrame, key: str, tokens: str, vocab: DataFrame, unknown: int) -> DataFrame:
    """key and ids of its tokens in order; vocab (token, id) joins the exploded tokens."""
    each = rows.select(key, F.posexplode(tokens).alias("pos", "token")).join(vocab.select("token", "id"), "token", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id")))), lambda x: x["id"])
    return each.groupBy(key).agg(ids.alias("ids"))


def decoded(rows: DataFrame, key: str, ids: str, vocab: DataFrame, skipped: list[int]) -> DataFrame:
    """(key, text, n_skipped): tokens of the ids joined by spaces, without those to skip."""
    each = rows.select(key, F.posexplode(ids).alias("pos", "id"))
    kept = F.col("token").isNotNull() & ~F.col("id").isin(skipped)
    placed = each.join(vocab.select("id", "token"), "id", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "token")))).alias("t"), F.count_if(~kept).alias("n_skipped"))
    return placed.select(key, F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("text"), "n_skipped")
