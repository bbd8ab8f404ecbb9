"""Filters of next-token scores, beam steps and answer spans, on exploded (row, token, logit) relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MINUS_INF = float("-inf")


def exploded(rows: DataFrame, key: str, logits: str) -> DataFrame:
    """(key, token, logit) with tokens numbered from 0."""
    return rows.select(key, F.posexplode(logits).alias("token", "logit"))


def softmaxed(rows: DataFrame, key: str, score: str = "logit", name: str = "p") -> DataFrame:
    w = Window.partitionBy(key)
    e = rows.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_k_filtered(rows: DataFrame, key: str, k: int, fill: float = MINUS_INF) -> DataFrame:
    """All scores below the k-th of their row become fill; ties with it stay."""
    rank = F.rank().over(Window.partitionBy(key).orderBy(F.desc("logit")))
    return rows.withColumn("_r", rank).withColumn("logit", F.when(F.col("_r") <= k, F.col("logit")).otherwise(fill)).drop("_r")


def top_p_filtered(rows: DataFrame, key: str, p: float, keep: int = 1, fill: float = MINUS_INF) -> DataFrame:
    """The smallest set of most probable tokens whose probability is over p, keep at least."""
    order = Window.partitionBy(key).orderBy(F.desc("logit"), "token")
    before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = softmaxed(rows, key).withColumn("_before", before).withColumn("_n", F.row_number().over(order))
    return rows.withColumn("logit", F.when((F.col("_before") <= p) | (F.col("_n") <= keep), F.col("logit")).otherwise(fill)).drop("p", "_before", "_n")


def temperature(rows: DataFrame, t: float) -> DataFrame:
    if t <= 0:
        raise ValueError("temperature must be over 0")
    return rows.withColumn("logit", F.col("logit") / t)


def repetition_penalty(rows: DataFrame, generated: DataFrame, key: str, penalty: float) -> DataFrame:
    """Scores of tokens in generated (key, token) are divided by penalty, or multiplied where negative."""
    seen = generated.select(key, "token").distinct().withColumn("_seen", F.lit(True))
    out = rows.join(seen, [key, "token"], "left")
    punished = F.when(F.col("logit") < 0, F.col("logit") * penalty).otherwise(F.col("logit") / penalty)
    return out.withColumn("logit", F.when(F.col("_seen"), punished).otherwise(F.col("logit"))).drop("_seen")


def min_length(rows: DataFrame, length: str, least: int, eos: int) -> DataFrame:
    return rows.withColumn("logit", F.when((F.col(length) < least) & (F.col("token") == eos), MINUS_INF).otherwise(F.col("logit")))


def banned_ngrams(sequences: DataFrame, key: str, n: int) -> DataFrame:
    """(key, token) that would repeat an n-gram of the sequence (key, pos, token)."""
    w = Window.partitionBy(key).orderBy("pos")
    # All in one order of one shuffle: the n - 1 tokens before a place are compared with the sequence's last ones.
    before = sequences.select(key, "pos", "token", *[F.lag("token", i).over(w).alias(f"t{i}") for i in range(1, n)])
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = before.select(key, "token", *[f"t{i}" for i in range(1, n)], *[F.last("token" if i == 1 else f"t{i - 1}").over(whole).alias(f"s{i}") for i in range(1, n)])
    for i in range(1, n):
        ends = ends.where(F.col(f"t{i}") == F.col(f"s{i}"))
    return ends.select(key, "token").distinct()


def banned(rows: DataFrame, bans: DataFrame, key: str) -> DataFrame:
    out = rows.join(bans.select(key, "token").distinct().withColumn("_ban", F.lit(True)), [key, "token"], "left")
    return out.withColumn("logit", F.when(F.col("_ban"), MINUS_INF).otherwise(F.col("logit"))).drop("_ban")


def bad_words(sequences: DataFrame, words: list[list[int]], key: str, eos: int) -> DataFrame:
    """(key, token) that would end one of the words (token ids): words of one token always, longer ones where the
    sequence (key, tokens) ends in what goes before; eos alone is never banned."""
    if not words or any(not w or min(w) < 0 for w in words):
        raise ValueError("words are non-empty lists of token ids")
    ends = lambda w: F.lit(True) if len(w) == 1 else (F.size("tokens") >= len(w) - 1) & (F.slice("tokens", F.greatest(F.size("tokens") - len(w) + 2, F.lit(1)), F.lit(len(w) - 1)) == F.array(*[F.lit(x) for x in w[:-1]]))
    each = [F.when(ends(w), F.lit(w[-1])) for w in words if w != [eos]]
    return sequences.select(key, F.explode(F.array_compact(F.array(*each))).alias("token")).distinct() if each else sequences.select(key, F.lit(None).cast("int").alias("token")).limit(0)


def chained(rows: DataFrame, *steps) -> DataFrame:
    """rows after each of the steps in turn, functions from a table of scores to another."""
    for step in steps:
        rows = step(rows)
    return rows


def top_k_top_p(rows: DataFrame, key: str, k: int = 0, p: float = 1.0, keep: int = 1) -> DataFrame:
    """The k best tokens, keep at least, and of those the most probable ones up to p."""
    rows = top_k_filtered(rows, key, max(k, keep)) if k > 0 else rows
    return top_p_filtered(rows, key, p, keep) if p < 1 else rows


def beam_step(candidates: DataFrame, beams: int, eos: int) -> tuple[DataFrame, DataFrame]:
    """From (batch, beam, token, score): the next beams, and the hypotheses that end.

    Of the 2 * beams best, those with eos end if they are among the first beams; the first beams of the
    others go on.
    """
    order = Window.partitionBy("batch").orderBy(F.desc("score"), "beam", "token")
    best = candidates.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < 2 * beams)
    ended = best.where((F.col("token") == eos) & (F.col("rank") < beams))
    on = best.where(F.col("token") != eos).withColumn("slot", F.row_number().over(Window.partitionBy("batch").orderBy("rank")) - 1)
    return on.where(F.col("slot") < beams).drop("rank"), ended


def best_hypotheses(ended: DataFrame, n: int, length_penalty: float = 1.0) -> DataFrame:
    """The n hypotheses (batch, length, score) of each batch with the best score / length ** penalty."""
    scored = ended.withColumn("value", F.col("score") / F.pow(F.col("length").cast("double"), F.lit(length_penalty)))
    order = Window.partitionBy("batch").orderBy(F.desc("value"), "beam", "token")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def answer_spans(rows: DataFrame, key: str, n_best: int, longest: int, k: int) -> DataFrame:
    """The k best spans by start + end score, from (key, pos, start, end): only the n_best starts and ends
    take part, an end isn't before its start, and no span is longer than longest."""
    starts = Window.partitionBy(key).orderBy(F.desc("start"), "pos")
    ends = Window.partitionBy(key).orderBy(F.desc("end"), "pos")
    s = rows.withColumn("_n", F.row_number().over(starts)).where(F.col("_n") <= n_best).select(key, F.col("pos").alias("start_at"), "start")
    e = rows.withColumn("_n", F.row_number().over(ends)).where(F.col("_n") <= n_best).select(key, F.col("pos").alias("end_at"), "end")
    both = s.join(e, key).where((F.col("end_at") >= F.col("start_at")) & (F.col("end_at") - F.col("start_at") < longest))
    scored = both.withColumn("score", F.col("start") + F.col("end"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "start_at", "end_at")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
