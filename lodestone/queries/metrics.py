"""Evaluation metrics, on labels, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ._registry import query, read

CM = """c AS (SELECT sum((toxic = 1 AND quality = 1)::INT)::DOUBLE tp, sum((toxic = 0 AND quality = 0)::INT)::DOUBLE tn,
sum((toxic = 1 AND quality = 0)::INT)::DOUBLE fp, sum((toxic = 0 AND quality = 1)::INT)::DOUBLE fn FROM labels)"""


@query(
    "metric_classification",
    f"""WITH {CM} SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS acc, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
round(((tp + tn) / (tp + tn + fp + fn) + 2 * tp / (2 * tp + fp + fn)) / 2, 9) AS acc_and_f1,
round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM c""",
)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.classification(read(spark, sf_dir, "labels"), "toxic", "quality")
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(
    "metric_regression",
    """SELECT l_returnflag, round(avg(abs(p - g)), 6) AS mae, round(avg((p - g) ** 2), 4) AS mse, round(sqrt(avg((p - g) ** 2)), 6) AS rmse, round(1 - avg((p - g) ** 2) / var_pop(g), 6) AS r2
FROM (SELECT l_returnflag, l_quantity * 1000 AS p, l_extendedprice AS g FROM lineitem) GROUP BY 1""",
)
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1000).alias("p"), F.col("l_extendedprice").alias("g"))
    r = metrics.regression(rows, "p", "g", ["l_returnflag"])
    return r.select("l_returnflag", F.round("mae", 6).alias("mae"), F.round("mse", 4).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(
    "metric_pearson_spearman",
    """WITH r AS (SELECT l_returnflag, l_quantity a, l_extendedprice b,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS ra,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS rb FROM lineitem)
SELECT l_returnflag, round(corr(a, b), 8) AS pearson, round(corr(ra, rb), 8) AS spearmanr, round((corr(a, b) + corr(ra, rb)) / 2, 8) AS corr FROM r GROUP BY 1""",
)
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.correlations(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", *[F.round(c, 8).alias(c) for c in ("pearson", "spearmanr", "corr")])


RISK = "s AS (SELECT o_totalprice AS score, (o_orderstatus = 'F')::INT AS gold FROM orders)"


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("gold"))


@query(
    "metric_auroc",
    f"""WITH {RISK}, b AS (SELECT score, sum(gold) AS pos, sum(1 - gold) AS neg FROM s GROUP BY 1),
c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below FROM b)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9)::DOUBLE AS auroc FROM c""",
)
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(_risk(spark, sf_dir), "score", "gold").select(F.round("auroc", 9).alias("auroc"))


@query(
    "metric_average_precision",
    f"""WITH {RISK}, b AS (SELECT score, sum(gold)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM s GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER w / sum(n) OVER w AS p FROM b WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(pos * p) / sum(pos), 9) AS average_precision FROM c""",
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_risk(spark, sf_dir), "score", "gold").select(F.round("average_precision", 9).alias("average_precision"))


@query(
    "metric_best_threshold",
    """WITH r AS (SELECT l_discount AS na, (l_returnflag <> 'N')::INT AS has, (l_linenumber % 2)::DOUBLE AS score FROM lineitem),
b AS (SELECT na, sum(CASE WHEN has = 1 THEN score ELSE -1 END) AS d FROM r GROUP BY 1),
w AS (SELECT na::DOUBLE AS threshold, sum(d) OVER (ORDER BY na ROWS UNBOUNDED PRECEDING) AS gain FROM b UNION ALL SELECT 0, 0),
g AS (SELECT threshold, gain FROM w ORDER BY gain DESC, threshold LIMIT 1)
SELECT threshold AS best_thresh, round(100 * ((SELECT sum((has = 0)::INT) FROM r) + gain) / (SELECT count(*) FROM r), 6) AS best_score FROM g""",
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("na"), (F.col("l_returnflag") != "N").cast("int").alias("has"), (F.col("l_linenumber") % 2).cast("double").alias("score"))
    return metrics.best_threshold(rows, "na", "has", "score").select("best_thresh", F.round("best_score", 6).alias("best_score"))


@query(
    "metric_eval_slices",
    """SELECT CASE WHEN grouping(has) = 1 THEN 'all' WHEN has = 1 THEN 'HasAns' ELSE 'NoAns' END AS slice, count(*) AS total, round(100 * avg(score), 6) AS exact
FROM (SELECT (l_returnflag <> 'N')::INT AS has, l_linenumber % 2 AS score FROM lineitem) GROUP BY GROUPING SETS ((), (has))""",
)
def eval_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") != "N").cast("int").alias("has"), (F.col("l_linenumber") % 2).alias("score"))
    return metrics.eval_slices(rows, "has", "score", "score").select("slice", "total", F.round("exact", 6).alias("exact"))


_CLASSED = {"cola": ["mcc"], "sst-2": ["acc"], "mrpc": ["acc", "f1", "acc_and_f1"], "qqp": ["acc", "f1", "acc_and_f1"], "mnli": ["mnli/acc"], "mnli-mm": ["mnli-mm/acc"], "qnli": ["acc"], "rte": ["acc"], "wnli": ["acc"], "hans": ["acc"]}
_MEASURE = {"acc": "(tp + tn) / (tp + tn + fp + fn)", "f1": "2 * tp / (2 * tp + fp + fn)", "mcc": "(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"}
_MEASURE["acc_and_f1"] = f"({_MEASURE['acc']} + {_MEASURE['f1']}) / 2"


@query(
    "metric_task_scores",
    f"WITH {CM}, o AS (SELECT o_totalprice AS a, o_custkey AS b, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS ra, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS rb FROM orders), "
    "k AS (SELECT corr(a, b) AS p, corr(ra, rb) AS s FROM o) "
    + " UNION ALL ".join(f"SELECT '{t}' AS task, '{m}' AS measure, round({_MEASURE[m.split('/')[-1]]}, 8) AS value FROM c" for t, ms in _CLASSED.items() for m in ms)
    + " UNION ALL SELECT 'sts-b', unnest(['pearson', 'spearmanr', 'corr']), unnest([round(p, 8), round(s, 8), round((p + s) / 2, 8)]) FROM k",
)
def task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every task: of the classes that labels gives, and of two numbers of each order."""
    labels, orders = read(spark, sf_dir, "labels"), read(spark, sf_dir, "orders")
    out = None
    for task in metrics.TASKS:
        scores = metrics.task_metrics(task, orders, "o_totalprice", "o_custkey") if task == "sts-b" else metrics.task_metrics(task, labels, "toxic", "quality")
        long = scores.select(F.lit(task).alias("task"), F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(F.col(f"`{c}`"), 8).alias("value")) for c in scores.columns])))
        out = long if out is None else out.union(long)
    return out


@query("metric_split_counts", "SELECT source AS split, count(DISTINCT lang) AS receptors, count(*) AS fragments, count(DISTINCT n_chars) AS unique_fragments FROM documents GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("split")).agg(F.countDistinct("lang").alias("receptors"), F.count("*").alias("fragments"), F.countDistinct("n_chars").alias("unique_fragments"))


@query("metric_epoch_loss", "SELECT r_name AS run, coalesce(round(avg(c_acctbal), 6), -1) AS loss FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY 1")
def epoch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return nations.join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("r_name").alias("run")).agg(F.coalesce(F.round(F.avg("c_acctbal"), 6), F.lit(-1.0)).alias("loss"))


@query("metric_best_run", "SELECT c_mktsegment AS study, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS best_run, max(c_acctbal) AS objective FROM customer GROUP BY 1")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("study")).agg(F.max_by("c_custkey", F.struct(F.col("c_acctbal"), -F.col("c_custkey"))).alias("best_run"), F.max("c_acctbal").alias("objective"))
