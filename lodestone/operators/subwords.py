"""Word pieces of distinct words, with the vocabulary as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary is broadcast up to so many tokens of 64 bytes, and joined by a shuffle beyond.
BROADCAST_TOKENS = 1 << 20


def word_pieces(words: DataFrame, vocabulary: DataFrame, unknown: str = "[UNK]", prefix: str = "##", longest: int = 100) -> DataFrame:
    """(word, pieces): the longest piece of the vocabulary (token) from the left, again and again; later ones have prefix.

    A word of more than longest characters, or that doesn't come out, is unknown as a whole.  words
    has distinct, non-empty words.  All places of a word are joined with the vocabulary at once; what is left
    is a fold over the longest match of each place.
    """
    widest, count = vocabulary.agg(F.max(F.char_length("token")), F.count("*")).first()
    words = words.select("word", F.char_length("word").alias("n"))
    fitting = words.where(F.col("n") <= longest)
    at = fitting.select("word", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("at"))
    each = at.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(widest or 1), F.col("n") - F.col("at") + 1))).alias("size"))
    each = each.withColumn("token", F.concat(F.when(F.col("at") > 1, prefix).otherwise(""), F.substring(F.col("word"), F.col("at"), F.col("size"))))
    known = vocabulary.select("token").distinct()
    found = each.join(F.broadcast(known) if count <= BROADCAST_TOKENS else known, "token", "left_semi").groupBy("word", "at").agg(F.max("size").alias("size"))
    sizes = found.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("sizes"))
    rows = words.join(sizes, "word", "left")

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, i):
        size = F.try_element_at("sizes", acc["at"])
        token = F.concat(F.when(acc["at"] > 1, prefix).otherwise(""), F.substring(F.col("word"), acc["at"], size))
        # A place without a match is left at -1, from which nothing goes on.
        return F.when((i != acc["at"]) | (acc["at"] < 0), acc).when(size.isNull(), F.struct(F.lit(-1).alias("at"), acc["out"].alias("out"))).otherwise(F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(token)).alias("out")))

    whole = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step, lambda acc: F.when(acc["at"] == F.col("n") + 1, acc["out"]))
    return rows.select("word", F.coalesce(F.when(F.col("sizes").isNotNull(), whole), F.array(F.lit(unknown))).alias("pieces"))
