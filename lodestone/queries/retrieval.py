"""Label sets, nearest entries, ensembles and their scores, on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import owa
from ..functions.vectors import cosine, doubles, mse
from ..operators import inner_products, retrieval
from ._registry import query, read

E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles(F.col("embedding")).alias("vector"))


@query(
    "retrieval_topk",
    f"""{E}
SELECT a.vec_id AS query_id, row_number() OVER w AS rank, b.vec_id AS match_id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity
FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) QUALIFY rank <= 5""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return retrieval.top_k(rows.where("id % 20 = 0"), rows, 5, digits=9, exclude_self=True)


@query(
    "retrieval_inner_product",
    f"""{E}
SELECT a.vec_id AS query_id, row_number() OVER w AS rank, b.vec_id AS match_id, round(list_dot_product(a.v, b.v), 6) AS similarity
FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.vec_id) QUALIFY rank <= 5""",
)
def inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return retrieval.top_k(rows.where("id % 20 = 0"), rows, 5, "inner", digits=6, exclude_self=True)


@query(
    "retrieval_inner_product_cells",
    """WITH e AS (SELECT vec_id, [x * (1 + vec_id % 3 * 0.25) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings)
SELECT a.vec_id AS query_id, row_number() OVER w AS rank, b.vec_id AS id, round(list_dot_product(a.v, b.v), 9) AS score
FROM e a, e b WHERE a.vec_id % 20 = 0
WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) QUALIFY rank <= 5""",
)
def inner_product_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the index, of vectors of three lengths, exactly."""
    rows = vectors(spark, sf_dir).select("id", F.transform("vector", lambda x: x * (1 + F.col("id") % 3 * 0.25)).alias("vector"))
    return inner_products.search(inner_products.build(rows, 5), rows.where("id % 20 = 0"), 5, exact=True)


TARGETS = f"""{E}, q AS (SELECT a.vec_id, a.v, t.v AS target FROM e a JOIN e t ON t.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0),
d AS (SELECT q.vec_id AS query_id, list_cosine_similarity(q.v, b.v) AS near, list_cosine_similarity(q.v, q.target) AS wanted FROM q, e b),
s AS (SELECT query_id, arg_min(near, (abs(near - wanted), -near)) AS snapped FROM d GROUP BY 1),
r AS (SELECT query_id, sum((near > snapped + 1e-12)::INT)::BIGINT AS rank FROM d JOIN s USING (query_id) GROUP BY 1)"""


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    target = rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("target"))
    return retrieval.target_ranks(rows.where("id % 20 = 0").join(target, "id"), rows)


@query("retrieval_target_rank", f"{TARGETS} SELECT query_id, rank FROM r")
def target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(spark, sf_dir)


@query(
    "retrieval_target_rank_snapped",
    f"""{E}, q AS (SELECT vec_id, v, [-x FOR x IN v[2:]] || [v[1]] AS target FROM e WHERE vec_id % 20 = 0), l AS (SELECT DISTINCT v FROM e),
d AS (SELECT vec_id AS query_id, list_cosine_similarity(q.v, l.v) AS near, list_cosine_similarity(q.v, q.target) AS wanted FROM q, l),
s AS (SELECT query_id, arg_min(near, (abs(near - wanted), -near)) AS snapped FROM d GROUP BY 1)
SELECT query_id, sum((near > snapped + 1e-12)::INT)::BIGINT AS rank FROM d JOIN s USING (query_id) GROUP BY 1""",
)
def snapped_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that no row of the label set has; equal rows count once."""
    rows = vectors(spark, sf_dir)
    n = F.size("vector")
    target = F.concat(F.transform(F.slice(F.col("vector"), F.lit(2), n - 1), lambda x: -x), F.slice("vector", 1, 1))
    return retrieval.target_ranks(rows.where("id % 20 = 0").withColumn("target", target), rows, ignore_duplicates=True)


@query("retrieval_topk_accuracy", f"{TARGETS} SELECT k::INT AS k, round(avg((rank < k)::INT), 9) AS accuracy FROM r, (SELECT unnest([1, 8, 16, 32, 64, 128]) AS k) GROUP BY 1")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k_accuracy(ranks(spark, sf_dir), [1, 8, 16, 32, 64, 128]).select("k", F.round("accuracy", 9).alias("accuracy"))


def _signs(n: int) -> str:
    return " || ".join(f"(CASE WHEN embedding[{i}] > 0 THEN '1' ELSE '0' END)" for i in range(1, n + 1))


@query("label_set_keep_last", f"SELECT fp, max(vec_id) AS entry FROM (SELECT vec_id, {_signs(6)} AS fp FROM embeddings) GROUP BY 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = F.concat(*[F.when(F.get("embedding", F.lit(i)) > 0, "1").otherwise("0") for i in range(6)])
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry"), fp.alias("fp"))
    return retrieval.keep_last(rows, "fp", "entry").select("fp", "entry")


@query(
    "label_set_union",
    f"""WITH s AS (SELECT vec_id, label, {_signs(6)} AS fp, CASE WHEN label < 3 THEN 0 WHEN label < 6 THEN -1 ELSE -2 END AS r FROM embeddings)
SELECT fp, vec_id AS entry FROM s QUALIFY row_number() OVER (PARTITION BY fp ORDER BY r DESC, vec_id DESC) = 1""",
)
def label_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = F.concat(*[F.when(F.get("embedding", F.lit(i)) > 0, "1").otherwise("0") for i in range(6)])
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry"), fp.alias("fp"), "label")
    parts = [rows.where("label < 3"), rows.where("label >= 3 and label < 6"), rows.where("label >= 6")]
    return retrieval.label_set([p.drop("label") for p in parts], "fp", "entry").select("fp", "entry")


@query("ensemble_rotation_mean", f"{E}, p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) SELECT label, pos::INT AS pos, round(avg(x), 9) AS value FROM p GROUP BY 1, 2")
def rotation_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = retrieval.mean_vector(vectors(spark, sf_dir), ["label"], "vector")
    return mean.select("label", F.posexplode("vector").alias("pos", "value")).select("label", "pos", F.round("value", 9).alias("value"))


@query(
    "ensemble_checkpoint_mean",
    f"""{E}, p AS (SELECT label, vec_id % 3 AS ckpt, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e),
m AS (SELECT label, ckpt, pos, avg(x) AS x FROM p GROUP BY ALL) SELECT label, pos::INT AS pos, round(avg(x), 9) AS value FROM m GROUP BY 1, 2""",
)
def checkpoint_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("ckpt", F.col("id") % 3)
    mean = retrieval.mean_vector(retrieval.mean_vector(rows, ["label", "ckpt"], "vector"), ["label"], "vector")
    return mean.select("label", F.posexplode("vector").alias("pos", "value")).select("label", "pos", F.round("value", 9).alias("value"))


#: Values of a vector in (0, 1).
def _unit(v):
    return F.transform(v, lambda x: 1 / (1 + F.exp(-x)))


SORTED = """s AS (SELECT vec_id, list_reverse_sort([1 / (1 + exp(-x)) FOR x IN embedding::DOUBLE[]]) AS s, len(embedding) AS n FROM embeddings),
i AS (SELECT vec_id, n, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM s)"""


def _smooth_sql(form: int) -> str:
    w = "CASE WHEN i = n - 1 THEN pow(1 - a, i) ELSE a * pow(1 - a, i) END" if form == 1 else "CASE WHEN i = 0 THEN pow(a, n - 1) ELSE (1 - a) * pow(a, n - 1 - i) END"
    return f"WITH {SORTED}, a AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS a) SELECT vec_id, a AS alpha, round(sum(x * ({w})), 8) AS value FROM i, a GROUP BY 1, 2"


def _smooth(form: int):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, "embeddings").select("vec_id", _unit(doubles(F.col("embedding"))).alias("v"))
        each = [F.struct(F.lit(a / 10).alias("alpha"), F.round(owa.operator(f"owa_exp_smooth{form}_0{a}")(F.col("v")), 8).alias("value")) for a in range(1, 10)]
        return rows.select("vec_id", F.inline(F.array(*each)))

    return q


query("owa_smoothing_1", _smooth_sql(1))(_smooth(1))
query("owa_smoothing_2", _smooth_sql(2))(_smooth(2))


@query(
    "owa_quantifiers",
    f"""WITH {SORTED}, q AS (SELECT * FROM (VALUES ('owa1', 0.0::DOUBLE, 0.5::DOUBLE), ('owa2', 0.3, 0.8), ('owa3', 0.5, 1.0)) t(name, a, b))
SELECT vec_id, name, round(sum(x * (greatest(0, least(1, ((i + 1) / n - a) / (b - a))) - greatest(0, least(1, (i / n - a) / (b - a))))), 8) AS value FROM i, q GROUP BY 1, 2""",
)
def quantifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", _unit(doubles(F.col("embedding"))).alias("v"))
    each = [F.struct(F.lit(n).alias("name"), F.round(owa.operator(n)(F.col("v")), 8).alias("value")) for n in owa.QUANTIFIERS]
    return rows.select("vec_id", F.inline(F.array(*each)))


@query("fuzzy_integrals", f"WITH {SORTED} SELECT vec_id, round(sum(x * (pow((i + 1) / n, 2) - pow(i / n, 2))), 8) AS choquet, round(max(least(x, (i + 1) / n)), 8) AS sugeno FROM i GROUP BY 1")
def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", _unit(doubles(F.col("embedding"))).alias("v"))
    return rows.select("vec_id", F.round(owa.choquet(F.col("v"), 2.0), 8).alias("choquet"), F.round(owa.sugeno(F.col("v")), 8).alias("sugeno"))


PAIRS = f"{E}, p AS (SELECT a.vec_id, a.label, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    other = rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return rows.join(other, "id")


@query("loss_cosine_mse", f"{PAIRS} SELECT vec_id, round(1 - list_cosine_similarity(a, b), 9) AS cos_loss, round(list_distance(a, b) ** 2 / len(a), 9) AS mse_loss FROM p")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(1 - cosine(F.col("vector"), F.col("other")), 9).alias("cos_loss"), F.round(mse(F.col("vector"), F.col("other")), 9).alias("mse_loss"))


@query(
    "loss_activity_weighted",
    f"""{PAIRS}, act AS (SELECT l_suppkey AS k, avg(l_discount) AS activity, avg(l_tax) AS prevalence FROM lineitem GROUP BY 1)
SELECT label, round(avg((1 - list_cosine_similarity(a, b)) * coalesce(activity, 0) * exp(-coalesce(prevalence, 0))), 9) AS loss FROM p LEFT JOIN act ON k = vec_id GROUP BY 1""",
)
def activity_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg("l_discount").alias("activity"), F.avg("l_tax").alias("prevalence"))
    loss = (1 - cosine(F.col("vector"), F.col("other"))) * F.coalesce("activity", F.lit(0.0)) * F.exp(-F.coalesce("prevalence", F.lit(0.0)))
    return pairs(spark, sf_dir).join(act, "id", "left").groupBy("label").agg(F.round(F.avg(loss), 9).alias("loss"))


@query("cache_lookup", "SELECT p_partkey AS part, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, p_size * 1.5) AS value FROM part")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    cache = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("value"))
    sizes = part.select(F.col("p_partkey").alias("part"), (F.col("p_size") * 1.5).alias("computed"))
    compute = lambda missing: missing.join(sizes, "part").select("part", F.col("computed").alias("value"))
    return retrieval.with_cached(part.select(F.col("p_partkey").alias("part")), cache, "part", "value", compute).select("part", "value")
