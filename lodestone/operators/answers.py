"""Answers of extractive question answering: contexts of tokens, n-best lists, decoding and scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import exact_match, normalize_answer, token_f1


def max_context(spans: DataFrame, key: str) -> DataFrame:
    """(key, pos, start): for each token, of the spans (key, start, n) that hold it the one with most context:
    the lesser number of tokens to its left or right, plus a hundredth of the length; the first of equals."""
    of = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n")))).alias("spans"))
    best = of.select(key, F.arrow_udf(_most_context, "array<struct<pos: int, start: int>>")("spans").alias("best"))
    return best.select(key, F.explode_outer("best").alias("x")).where("x IS NOT NULL").select(key, F.col("x.pos").alias("pos"), F.col("x.start").cast(spans.schema["start"].dataType).alias("start"))


def _most_context(rows: pa.Array) -> pa.Array:
    """pos and start of each token of each row's spans, which are looked at one behind the other; the first start of equals stays."""
    sizes, places, starts = [], [], []
    n, flat = rows.value_lengths().to_numpy(zero_copy_only=False), rows.flatten()
    begin, size, at = flat.field("start").to_numpy(), flat.field("n").to_numpy(), 0
    for k in n:
        b, m = begin[at : at + k], size[at : at + k]
        at += k
        low, high = (b.min(), (b + m).max()) if k else (0, 0)
        best, start = np.full(high - low, -np.inf), np.zeros(high - low, np.int32)
        for s, w in zip(b, m, strict=True):
            i = np.arange(w)
            score = np.minimum(i, w - 1 - i) + 0.01 * w
            part = slice(s - low, s - low + w)
            better = score > best[part]
            best[part][better], start[part][better] = score[better], s
        held = np.flatnonzero(best > -np.inf)
        sizes.append(len(held))
        places.append(held + low)
        starts.append(start[held])
    values = [pa.array((np.concatenate(v) if v else np.zeros(0)).astype(np.int32)) for v in (places, starts)]
    return pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.StructArray.from_arrays(values, ["pos", "start"]))


def with_results(features: DataFrame, results: DataFrame) -> DataFrame:
    """The features of each example (example, unique_id, ...) with the model's results (unique_id, ...), numbered from 0
    within the example; a feature without a result is an error."""
    both = features.join(results.withColumn("_found", F.lit(True)), "unique_id", "left")
    order = Window.partitionBy("example").orderBy("unique_id")
    feature = F.when(F.col("_found"), F.row_number().over(order) - 1).otherwise(F.raise_error(F.concat(F.lit("no result for "), F.col("unique_id").cast("string"))).cast("int"))
    return both.withColumn("feature", feature).drop("_found")


def candidates(rows: DataFrame, key: str, n_best: int, longest: int) -> DataFrame:
    """(key, feature, start_at, end_at, score) of the spans between the n_best starts and ends of each feature,
    from tokens (key, feature, pos, start, end, usable): both ends are usable, and none is longer than longest."""
    of = [key, "feature"]
    best = lambda c: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc(c), "pos")) <= n_best
    rows = rows.withColumn("_s", best("start")).withColumn("_e", best("end")).where("usable")
    s = rows.where("_s").select(*of, F.col("pos").alias("start_at"), "start")
    e = rows.where("_e").select(*of, F.col("pos").alias("end_at"), "end")
    both = s.join(e, of).where((F.col("end_at") >= F.col("start_at")) & (F.col("end_at") - F.col("start_at") < longest))
    return both.select(*of, "start_at", "end_at", (F.col("start") + F.col("end")).alias("score"))


def candidates_of_tops(rows: DataFrame, key: str, longest: int) -> DataFrame:
    """The same from features with start_top (arrays of index and log_prob) and, for each of those, end_top."""
    s = rows.select(key, "feature", "usable_to", F.posexplode("start_top").alias("i", "s"), "end_top")
    e = s.select(key, "feature", "usable_to", "s", F.explode(F.get("end_top", F.col("i"))).alias("e"))
    fits = (F.col("s.index") < F.col("usable_to")) & (F.col("e.index") < F.col("usable_to")) & (F.col("e.index") >= F.col("s.index")) & (F.col("e.index") - F.col("s.index") < longest)
    return e.where(fits).select(key, "feature", F.col("s.index").alias("start_at"), F.col("e.index").alias("end_at"), (F.col("s.log_prob") + F.col("e.log_prob")).alias("score"))


def n_best_answers(found: DataFrame, examples: DataFrame, key: str, n: int) -> DataFrame:
    """(key, place, text, score, probability): the n best texts of each example, each text once.

    found has (key, feature, start_at, end_at, text, score).  examples has key and, where an empty answer is
    possible, null_score: the empty answer then takes part, and comes last if it isn't among the n best.  An
    example without any answer but the empty one also gets "empty" with score 0, before it.
    """
    order = F.struct("score", -F.col("feature"), -F.col("start_at"), -F.col("end_at"))
    rows = found.groupBy(key, "text").agg(F.max(order).alias("best")).select(key, "text", "best", F.lit(False).alias("null"))
    with_null = "null_score" in examples.columns
    if with_null:
        nothing = F.struct(F.col("null_score").cast("double").alias("score"), F.lit(0).alias("col2"), F.lit(0).alias("col3"), F.lit(0).alias("col4"))
        rows = rows.union(examples.select(key, F.lit(""), nothing.cast(rows.schema["best"].dataType), F.lit(True)))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("best"), F.desc("null"))))
    kept = placed.where((F.col("place") <= n) | F.col("null")).select(key, "place", "text", F.col("best")["score"].alias("score"))
    bare = examples.join(kept.where("text <> ''"), key, "left_anti").select(key, F.lit(0).alias("place"), F.lit("empty").alias("text"), F.lit(0.0).alias("score"))
    every = kept.union(bare)
    of = Window.partitionBy(key)
    every = every.withColumn("_e", F.exp(F.col("score") - F.max("score").over(of))).withColumn("place", F.row_number().over(of.orderBy("place")))
    return every.select(key, "place", "text", "score", (F.col("_e") / F.sum("_e").over(of)).alias("probability"))


def predictions(n_best: DataFrame, examples: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """(key, text, score_diff): the best answer; with null_score in examples, none ("") where the null score
    exceeds that of the best answer by more than threshold."""
    if "null_score" not in examples.columns:
        return n_best.where("place = 1").select(key, "text", F.lit(None).cast("double").alias("score_diff"))
    best = n_best.where("text <> ''").groupBy(key).agg(F.min_by(F.struct("text", "score"), "place").alias("b"))
    diff = F.col("null_score") - F.col("b.score")
    return examples.join(best, key).select(key, F.when(diff > threshold, "").otherwise(F.col("b.text")).alias("text"), diff.alias("score_diff"))


def decoded(rows: DataFrame, key: str, k: int, longest: int) -> DataFrame:
    """(key, feature, start_at, end_at, score, null_score): the k most probable spans of each feature, from tokens (key,
    feature, pos, start, end, context).  Only context tokens and the first one have a probability; the first
    one's is the null score, and then none."""
    of = Window.partitionBy(key, "feature")
    rows = rows.where(F.col("context") | (F.col("pos") == 0))
    for c in ("start", "end"):
        rows = rows.withColumn(c, F.exp(F.col(c) - F.max(c).over(of)))
        rows = rows.withColumn(c, F.col(c) / F.sum(c).over(of))
    null = rows.where("pos = 0").select(key, "feature", (F.col("start") * F.col("end")).alias("null_score"))
    usable = rows.where("context and pos > 0")
    s = usable.select(key, "feature", F.col("pos").alias("start_at"), F.col("start"), F.explode(F.sequence(F.col("pos"), F.col("pos") + longest - 1)).alias("end_at"))
    e = usable.select(key, "feature", F.col("pos").alias("end_at"), "end")
    both = s.join(e, [key, "feature", "end_at"]).select(key, "feature", "start_at", "end_at", (F.col("start") * F.col("end")).alias("score"))
    best = both.withColumn("_n", F.row_number().over(of.orderBy(F.desc("score"), "start_at", "end_at"))).where(F.col("_n") <= k).drop("_n")
    return best.join(null, [key, "feature"])


def best_decoded(found: DataFrame, key: str, k: int, impossible: bool = False) -> DataFrame:
    """(key, rank, feature, start_at, end_at, score) of the k best over all features; with impossible, the least null score
    stands for no answer (feature -1)."""
    rows = found.select(key, "feature", "start_at", "end_at", "score")
    if impossible:
        rows = rows.union(found.groupBy(key).agg(F.min("null_score").alias("score")).select(key, F.lit(-1).cast(found.schema["feature"].dataType), F.lit(0), F.lit(0), "score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "feature", "start_at", "end_at")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "feature", "start_at", "end_at", "score")


def squad_scores(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, has_answer, exact, f1): the greatest over an example's gold answers (key, answer), of which those that
    normalise to nothing are left out; "" counts where none is left.  Examples without a prediction (key, text)
    are left out."""
    some = F.filter(F.collect_list("answer"), lambda a: normalize_answer(a) != "")
    answers = gold.groupBy(key).agg(some.alias("answers"), F.max(F.col("answer").isNotNull()).alias("has_answer"))
    rows = answers.join(predicted.select(key, "text"), key)
    rows = rows.select(key, "has_answer", "text", F.explode(F.when(F.size("answers") > 0, F.col("answers")).otherwise(F.array(F.lit("")))).alias("answer"))
    exact, f1 = exact_match(F.col("text"), F.col("answer")), token_f1(F.col("text"), F.col("answer"))
    return rows.groupBy(key, "has_answer").agg(F.max(exact).alias("exact"), F.max(f1).alias("f1"))


def filled(rows: DataFrame, key: str, k: int, targets: list[int] | None = None) -> DataFrame:
    """(key, rank, token, score): the k most probable tokens of a masked place from (key, token, logit), or the
    targets in that order."""
    of = Window.partitionBy(key)
    rows = rows.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(of))).withColumn("score", F.col("_e") / F.sum("_e").over(of))
    if targets is not None:
        rows, k = rows.where(F.col("token").isin(targets)), len(targets)
    return rows.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "token"))).where(F.col("rank") <= k).select(key, "rank", "token", "score")


def one_mask(ids: Column, mask_id: int) -> Column:
    """The place of the only mask; an error where there are none or several."""
    n = F.size(F.filter(ids, lambda x: x == mask_id))
    return F.when(n == 1, F.array_position(ids, F.lit(mask_id)) - 1).otherwise(F.raise_error(F.concat(F.lit("masks: "), n.cast("string"))).cast("bigint"))
