"""Schedules, activations, streams of tokens, classification heads and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import schedules as L
from ..functions import vectors as V
from ..functions.text import whitespace_tokens
from ..operators import projection
from ..operators.sequences import numbered
from ..operators.streams_of_tokens import parallel_streams
from ..operators.vocabulary import encoded, vocabulary
from ..plans.evaluation import evaluated
from ._registry import query, read
from .retrieval import vectors

STEP = "s AS (SELECT c_custkey AS step FROM customer)"


@query(
    "schedule_multipliers",
    f"""WITH {STEP}, p AS (SELECT step, (step - 100) / 900::DOUBLE AS p, step < 100 AS warm, step / 100::DOUBLE AS w FROM s)
SELECT step, round(CASE WHEN warm THEN w ELSE 1 END, 9) AS constant, round(CASE WHEN warm THEN w ELSE greatest(0, (1000 - step) / 900::DOUBLE) END, 9) AS linear,
round(CASE WHEN warm THEN w ELSE greatest(0, 0.5 * (1 + cos(pi() * p))) END, 9) AS cosine, round(CASE WHEN warm THEN w WHEN p >= 1 THEN 0 ELSE 0.5 * (1 + cos(pi() * ((3 * p) % 1.0::DOUBLE))) END, 9) AS restarts,
round(CASE WHEN warm THEN w WHEN step > 1000 THEN 0.01 ELSE (0.99 * pow(1 - p, 2) + 0.01) END, 9) AS polynomial FROM p""",
)
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("step")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step"))
    columns = {"constant": L.constant(s, 100), "linear": L.linear(s, 100, 1000), "cosine": L.cosine(s, 100, 1000), "restarts": L.hard_restarts(s, 100, 1000, 3), "polynomial": L.polynomial(s, 100, 1000, 1.0, 0.01, 2.0)}
    return rows.select("step", *[F.round(c, 9).alias(n) for n, c in columns.items()])


@query(
    "activations",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE * 3 AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT vec_id, pos::INT AS pos, round(greatest(x, 0), 9) AS relu, round(tanh(x), 9) AS tanh, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(x / (1 + exp(-x)), 9) AS silu,
round(x * tanh(ln(1 + exp(x))), 9) AS mish, round(0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * pow(x, 3)))), 9) AS gelu_new FROM x""",
)
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", (F.col("v").cast("double") * 3).alias("x"))
    return rows.select("vec_id", "pos", *[F.round(V.ACTIVATIONS[n](F.col("x")), 9).alias(n) for n in ("relu", "tanh", "sigmoid", "silu", "mish", "gelu_new")])


@query(
    "tokens_parallel_streams",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey AS token, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS nth, count(*) OVER () // 8 AS len FROM lineitem),
r AS (SELECT nth // len AS stream, nth % len AS place, token FROM t WHERE nth < 8 * len)
SELECT a.place // 35 AS batch, a.stream::INT AS stream, a.place % 35 AS at, a.token, b.token AS target FROM r a JOIN r b ON a.stream = b.stream AND b.place = a.place + 1""",
)
def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return parallel_streams(rows, "nth", "l_partkey", 8, 35)


@query(
    "classification_scores",
    """WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM s),
p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p, x FROM e) SELECT vec_id, arg_max(i, (x, -i))::INT AS label, round(max(p), 9) AS score FROM p GROUP BY 1""",
)
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", V.argmax(F.col("v")).cast("int").alias("label"), F.round(F.array_max(V.softmax(F.col("v"))), 9).alias("score"))


@query(
    "zero_shot_ranks",
    """WITH s AS (SELECT vec_id, k::INT AS label, embedding[2 * k + 1]::DOUBLE AS contradiction, embedding[2 * k + 2]::DOUBLE AS entailment FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 2)) AS k FROM embeddings)),
e AS (SELECT *, exp(entailment - max(entailment) OVER (PARTITION BY vec_id)) AS e, 1 / (1 + exp(contradiction - entailment)) AS multi FROM s),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS single FROM e) SELECT vec_id, label, round(single, 9) AS single, round(multi, 9) AS multi, row_number() OVER (PARTITION BY vec_id ORDER BY entailment DESC, label)::INT AS rank FROM p""",
)
def zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda k: F.struct(k.alias("label"), F.get("embedding", 2 * k).cast("double").alias("c"), F.get("embedding", 2 * k + 1).cast("double").alias("e")))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.inline(pair))
    w = Window.partitionBy("vec_id")
    rows = rows.withColumn("x", F.exp(F.col("e") - F.max("e").over(w)))
    return rows.select("vec_id", "label", F.round(F.col("x") / F.sum("x").over(w), 9).alias("single"), F.round(V.sigmoid(F.col("e") - F.col("c")), 9).alias("multi"), F.row_number().over(w.orderBy(F.desc("e"), "label")).alias("rank"))


@query(
    "tokens_encoded",
    r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[^ \t-\r]+') AS w FROM benchmark), e AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM t),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM e GROUP BY 1 QUALIFY id <= 100)
SELECT item_id, string_agg(coalesce(id, 0)::VARCHAR, ',' ORDER BY pos) AS ids FROM e LEFT JOIN v USING (token) GROUP BY 1""",
)
def encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", whitespace_tokens(F.lower("text")).alias("tokens"))
    found = encoded(rows, "item_id", "tokens", vocabulary(rows, "tokens", ["<unk>"], 100), 0)
    return found.select("item_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("json_fields", """SELECT event_type, count(*) AS n, count(DISTINCT json_keys(props)::VARCHAR) AS shapes FROM events GROUP BY 1""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.to_json(F.struct(F.json_object_keys("props").alias("k")))).alias("shapes"))


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query(
    "window_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), "n")


NUMBERS = """u AS (SELECT vec_id AS id, [x / greatest(sqrt(list_sum([y * y FOR y IN v])), 1e-300) FOR x IN v] AS u FROM (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings))"""


@query(
    "pca_given_components",
    f"""WITH {NUMBERS}, g AS (SELECT unnest([1, 2, 3]) AS c), p AS (SELECT id, c, list_sum(list_transform(u, lambda x, i: x * cos(c * i))) AS y FROM u, g)
SELECT id, c::INT AS component, round(y - avg(y) OVER (PARTITION BY c), 8) AS value FROM p""",
)
def pca_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalising, projection by a given matrix and centring on the label set; the fit is pca_projection's."""
    import math

    rows = vectors(spark, sf_dir)
    width = len(rows.first()["vector"])
    given = [[math.cos(c * i) for i in range(1, width + 1)] for c in (1, 2, 3)]
    out = projection.centred(rows, given)(rows)
    return out.select("id", F.posexplode("components").alias("component", "value")).select("id", (F.col("component") + 1).alias("component"), F.round("value", 8).alias("value"))


@query("pca_projection", None)
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    project, _ = projection.fitted(rows, 2)
    return project(rows)


def _power(name: str, of: str, start: str, less: str) -> str:
    """Rounds of multiplying by the covariance; the other eigenvalues are smaller by enough."""
    return f"""{name} AS (SELECT 0 AS k, [({start})::DOUBLE FOR i IN range(width)] AS v FROM n UNION ALL
SELECT k + 1, list_transform(w, lambda z: z / sqrt(list_dot_product(w, w))) FROM (SELECT k, {less} AS w FROM (SELECT k, list_transform(rows, lambda r: list_dot_product(r, v)) AS w FROM {name}, {of} WHERE k < 6000){", a1" if less != "w" else ""}))"""


_LESS = "list_transform(w, lambda z, i: z - list_dot_product(w, v1) * v1[i])"


@query(
    "pca_magnitudes",
    f"""WITH RECURSIVE {NUMBERS}, x AS (SELECT id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u), m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1), c AS (SELECT id, i, x - m AS x FROM x JOIN m USING (i)),
cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (id) GROUP BY 1, 2), r AS MATERIALIZED (SELECT list(row ORDER BY i) AS rows FROM (SELECT i, list(v ORDER BY j) AS row FROM cov GROUP BY i)), n AS (SELECT count(*) AS width FROM m),
{_power("p1", "r", "1.0 + i * 0.01", "w")}, a1 AS MATERIALIZED (SELECT v AS v1 FROM p1 WHERE k = 6000),
{_power("p2", "r", "1.0 - i * 0.03", _LESS)}, a2 AS (SELECT v AS v2 FROM p2 WHERE k = 6000),
l AS (SELECT id, list(x ORDER BY i) AS x FROM c GROUP BY id)
SELECT id, 1::INT AS component, round(abs(list_dot_product(x, v1)), 6) AS magnitude FROM l, a1 UNION ALL SELECT id, 2, round(abs(list_dot_product(x, v2)), 6) FROM l, a2""",
)
def pca_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted projection without its signs, which are anyone's."""
    rows = vectors(spark, sf_dir)
    project, _ = projection.fitted(rows, 2)
    out = project(rows).select("id", F.posexplode("components").alias("c", "value"))
    return out.select("id", (F.col("c") + 1).alias("component"), F.round(F.abs("value"), 6).alias("magnitude"))


EVALUATION = """e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), x AS (SELECT vec_id, -1 - vec_id // 15 AS entry, (vec_id % 15) // 5 AS ckpt, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
c AS (SELECT entry, ckpt, pos, avg(x) AS x FROM x GROUP BY ALL), m AS (SELECT entry, pos, avg(x) AS x FROM c GROUP BY ALL), q AS (SELECT entry, list(x ORDER BY pos) AS v FROM m GROUP BY 1),
t AS (SELECT -1 - vec_id // 15 AS entry, arg_min(v, vec_id) AS target FROM e GROUP BY 1), d AS (SELECT entry, vec_id, list_cosine_similarity(q.v, e.v) AS near FROM q, e),
w AS (SELECT entry, list_cosine_similarity(q.v, target) AS wanted FROM q JOIN t USING (entry)), s AS (SELECT entry, arg_min(near, (abs(near - wanted), -near)) AS snapped FROM d JOIN w USING (entry) GROUP BY 1),
r AS (SELECT entry, sum((near > snapped + 1e-12)::INT) AS rank FROM d JOIN s USING (entry) GROUP BY 1), a AS (SELECT k::INT AS k, round(avg((rank < k)::INT), 9) AS accuracy FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY 1)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """15 ids in a row are the 3 checkpoints and 5 rotations of an entry, the first of them is its target."""
    rows = vectors(spark, sf_dir)
    entry = (-1 - F.floor(F.col("id") / 15)).cast("bigint")
    preds = rows.select(entry.alias("entry"), F.floor(F.col("id") % 15 / 5).alias("checkpoint"), (F.col("id") % 5).alias("rotation"), "id", "vector")
    targets = preds.groupBy("entry").agg(F.min_by("vector", "id").alias("target"))
    matches, accuracy = evaluated(preds.drop("id").join(targets, "entry"), rows, 5, digits=9)
    return matches, accuracy.select("k", F.round("accuracy", 9).alias("accuracy"))


@query(
    "batch_evaluation",
    f"""WITH {EVALUATION}, b AS (SELECT entry, vec_id, round(near, 9) AS similarity, row_number() OVER (PARTITION BY entry ORDER BY round(near, 9) DESC, vec_id)::INT AS rank FROM d QUALIFY rank <= 5)
SELECT entry AS query_id, rank, vec_id AS match_id, similarity, accuracy FROM b JOIN a ON k = rank""",
)
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, accuracy = _evaluated(spark, sf_dir)
    return matches.join(F.broadcast(accuracy.withColumnRenamed("k", "rank")), "rank").select("query_id", "rank", "match_id", "similarity", "accuracy")


@query("batch_evaluation_accuracy", f"WITH {EVALUATION} SELECT k, accuracy FROM a")
def evaluation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[1]
