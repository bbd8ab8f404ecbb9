"""Scores of predictions against gold values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import written
from .sequences import running

#: Distinct values whose ranks are broadcast.
FEW = 100_000


def counts(pred: Column, gold: Column) -> list[Column]:
    n = lambda c, name: F.sum(c.cast("bigint")).alias(name)
    return [n((pred == 1) & (gold == 1), "tp"), n((pred == 0) & (gold == 0), "tn"), n((pred == 1) & (gold == 0), "fp"), n((pred == 0) & (gold == 1), "fn")]


def classification(rows: DataFrame, pred: str, gold: str, keys: list[str] | None = None) -> DataFrame:
    """acc, f1, acc_and_f1 and mcc of 0/1 columns; a measure without a denominator is 0."""
    c = rows.groupBy(*(keys or [])).agg(*counts(F.col(pred), F.col(gold)))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    acc = (tp + tn) / (tp + tn + fp + fn)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(below > 0, (tp * tn - fp * fn) / F.sqrt(below)).otherwise(0.0)
    return c.select(*(keys or []), acc.alias("acc"), f1.alias("f1"), ((acc + f1) / 2).alias("acc_and_f1"), mcc.alias("mcc"))


def regression(rows: DataFrame, pred: str, gold: str, keys: list[str] | None = None) -> DataFrame:
    """mae, mse, rmse and r2; r2 is NaN where the gold values don't differ or there are fewer than two."""
    e = F.col(pred) - F.col(gold)
    g = F.col(gold).cast("double")
    c = rows.groupBy(*(keys or [])).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(g).alias("v"))
    return c.select(*(keys or []), "mae", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).otherwise(float("nan")).alias("r2"))


def average_ranks(rows: DataFrame, value: str, name: str, keys: list[str]) -> DataFrame:
    """rows with the rank of value within keys; tied values share the mean of their ranks.

    Ranks come from running counts of the distinct values: of all keys together, dealt out by range, so that a key may be of
    any size; or by key, if the values are at most FEW, and then they are broadcast to the rows.
    """
    by = written(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), "ranks")
    few = by.count() <= FEW
    upto = by.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))) if few else running(by, [*keys, value], {"_upto": "_n"})
    first = upto.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_first"))
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys]
    ranks = upto.alias("_l").join(first.alias("_r"), same) if keys else upto.crossJoin(F.broadcast(first)).alias("_l")
    ranks = ranks.select(*[F.col(f"_l.{c}").alias(f"_k{i}") for i, c in enumerate([*keys, value])], (F.col("_upto") - F.col("_first") - (F.col("_n") - 1) / 2).alias(name))
    match = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, value])]
    return rows.join(F.broadcast(ranks) if few else ranks, match).drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def correlations(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """pearson, spearmanr and their mean for each value of keys."""
    ranked = average_ranks(average_ranks(rows, a, "_ra", keys), b, "_rb", keys)
    c = ranked.groupBy(*keys).agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearmanr"))
    return c.withColumn("corr", (F.col("pearson") + F.col("spearmanr")) / 2)


def auroc(rows: DataFrame, score: str, gold: str) -> DataFrame:
    """Area under the ROC curve by rank sums over the distinct scores; ties count half."""
    by = rows.groupBy(score).agg(F.sum(F.col(gold).cast("bigint")).alias("pos"), F.sum((1 - F.col(gold)).cast("bigint")).alias("neg"))
    c = running(by, [score], {"upto": "neg"})
    c = c.agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return c.select((F.col("s") / (F.col("p") * F.col("n"))).alias("auroc"))


def average_precision(rows: DataFrame, score: str, gold: str) -> DataFrame:
    """Sum over distinct scores, descending, of precision times the gain in recall."""
    by = rows.groupBy(score).agg(F.sum(F.col(gold).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    c = running(by.withColumn("_down", -F.col(score)), ["_down"], {"found": "pos", "seen": "n"})
    return c.agg((F.sum(F.col("pos") * F.col("found") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def best_threshold(rows: DataFrame, na_prob: str, has_answer: str, score: str) -> DataFrame:
    """The threshold of no-answer probability at which the running score is first greatest.

    The score starts at the number of questions without an answer; going up by na_prob, an answered
    question adds its score, one without an answer takes 1 off unless nothing was predicted.
    """
    delta = F.when(F.col(has_answer) == 1, F.col(score)).otherwise(-1.0)
    by = rows.groupBy(na_prob).agg(F.sum(delta).alias("d"))
    start = rows.agg(F.sum((F.col(has_answer) == 0).cast("bigint")).alias("start"), F.count("*").alias("total"))
    swept = running(by, [na_prob], {"gain": "d"}).select(F.col(na_prob).cast("double").alias("threshold"), F.col("gain").cast("double").alias("gain"))
    swept = swept.union(rows.sparkSession.range(1).select(F.lit(0.0), F.lit(0.0)))
    best = swept.agg(F.max_by("threshold", F.struct("gain", -F.col("threshold"))).alias("best_thresh"), F.max("gain").alias("gain"))
    # Of two single rows.
    return best.crossJoin(start).select("best_thresh", (100 * (F.col("start") + F.col("gain")) / F.col("total")).alias("best_score"))


#: Task -> the measures it is scored by.
TASKS = {
    "cola": ["mcc"], "sst-2": ["acc"], "mrpc": ["acc", "f1", "acc_and_f1"], "sts-b": ["pearson", "spearmanr", "corr"], "qqp": ["acc", "f1", "acc_and_f1"],
    "mnli": ["mnli/acc"], "mnli-mm": ["mnli-mm/acc"], "qnli": ["acc"], "rte": ["acc"], "wnli": ["acc"], "hans": ["acc"],
}


def task_metrics(task: str, rows: DataFrame, pred: str, gold: str, keys: list[str] | None = None) -> DataFrame:
    """The measures of a task by name; any number of classes where accuracy alone is asked for."""
    if task not in TASKS:
        raise KeyError(task)
    keys = keys or []
    wanted = TASKS[task]
    if task == "sts-b":
        return correlations(rows, pred, gold, keys).select(*keys, *wanted)
    if wanted == ["mcc"] or "f1" in wanted:
        return classification(rows, pred, gold, keys).select(*keys, *wanted)
    return rows.groupBy(*keys).agg(F.avg((F.col(pred) == F.col(gold)).cast("double")).alias(wanted[0]))


def eval_slices(rows: DataFrame, has_answer: str, exact: str, f1: str) -> DataFrame:
    """slice (all, HasAns, NoAns), total, and exact and f1 in per cent."""
    name = F.when(F.grouping("_has") == 1, "all").when(F.col("_has") == 1, "HasAns").otherwise("NoAns")
    rows = rows.select(F.col(has_answer).alias("_has"), F.col(exact).alias("_exact"), F.col(f1).alias("_f1"))
    g = rows.groupingSets([[], [F.col("_has")]], F.col("_has"))
    return g.agg(name.alias("slice"), F.count("*").alias("total"), (100 * F.avg("_exact")).alias("exact"), (100 * F.avg("_f1")).alias("f1")).select("slice", "total", "exact", "f1")
