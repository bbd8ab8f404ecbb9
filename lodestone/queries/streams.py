"""Batches of token streams, permutation language models, and beam search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import permutations as P
from ..functions.tokens import MODULUS, MULTIPLIER
from ..operators import beams as B
from ..operators.sequences import numbered
from ..operators.streams_of_tokens import fixed_batches, shuffled_streams, stream_batches, variable_batches
from ._registry import query, read, spread

_TOKENS = """t AS (SELECT l_partkey AS token, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS nth, count(*) OVER () // 8 AS len FROM lineitem),
r AS (SELECT nth // len AS stream, nth % len AS place, token FROM t WHERE nth < 8 * len), n AS (SELECT count(*) // 8 AS len FROM lineitem)"""
_PLACED = """SELECT b.batch, a.stream::INT AS stream, k AS at, a.token, CASE WHEN k >= 0 THEN n.token END AS target FROM p b JOIN r a ON a.place = b.place LEFT JOIN r n ON n.stream = a.stream AND n.place = a.place + 1"""


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return numbered(read(spark, sf_dir, "lineitem").select(*order), order)


@query(
    "tokens_look_back_streams",
    f"""WITH {_TOKENS}, b AS (SELECT i AS batch, i * 35 AS start, least(35, len - 1 - i * 35) AS size FROM n, range(0, (len + 33) // 35) x(i)),
p AS (SELECT batch, k, start + k AS place FROM b, range(-8, 35) y(k) WHERE k >= -least(8, start) AND k < size)
{_PLACED}""",
)
def look_back_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_batches(_lineitem(spark, sf_dir), "nth", "l_partkey", 8, lambda t, n: fixed_batches(t, n, 35), look_back=8)


def _hashed(key: str, seed: int) -> str:
    first = f"((({key}) + {seed}) * {MULTIPLIER} % {MODULUS})"
    return f"((({first} >> 7) * {2246822519 % (1 << 31)} + {first}) % {MODULUS} / {MODULUS}.0)"


@query(
    "tokens_variable_streams",
    f"""WITH {_TOKENS}, d AS (
  SELECT i AS batch, least(50, greatest(5, trunc(CASE WHEN {_hashed("i * 3", 11)} < 0.95 THEN 35 ELSE 17.5 END + 5.0 * sqrt(-2 * ln(1 - {_hashed("i * 3 + 1", 11)})) * cos(2 * pi() * {_hashed("i * 3 + 2", 11)}))))::BIGINT AS size
  FROM n, range(0, (len + 4) // 5 + 1) x(i)),
s AS (SELECT batch, size, sum(size) OVER (ORDER BY batch) - size AS start FROM d),
b AS (SELECT batch, start::BIGINT AS start, least(size, len - 1 - start)::BIGINT AS size FROM s, n WHERE start < len - 2 OR batch = 0),
p AS (SELECT batch, k, start + k AS place FROM b, range(-4, 50) y(k) WHERE k >= -least(4, start) AND k < size)
{_PLACED}""",
)
def variable_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_batches(_lineitem(spark, sf_dir), "nth", "l_partkey", 8, lambda t, n: variable_batches(t, n, 35, seed=11), look_back=4)


@query("tokens_shuffled_streams")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents, packed by source in the order of a hash."""
    lines = read(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    words = F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sentences = lines.select("file", (F.col("doc_id") * (1 << 20) + F.col("nth")).alias("id"), F.transform(words, lambda w: F.crc32(F.encode(w, "UTF-8"))).alias("tokens"))
    packed = shuffled_streams(sentences, 4, 35, look_back=7, seed=3)
    digest = F.crc32(F.array_join(F.concat("data", F.lit([-1]).cast("array<bigint>"), "target"), ",").cast("binary"))
    return packed.select("part", "batch", "stream", F.size("data").alias("n_data"), F.size("target").alias("n_target"), digest.alias("crc32"))


#: What follows a token, by how often it does in the lines of an order.
_EOS, _KINDS = 1, 12


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """last, token and score: the logarithm of how often token comes after last, each counted once more, over all."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % _KINDS).cast("int").alias("token"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("token").alias("next"))
    n = lines.join(after, ["l_orderkey", "l_linenumber"]).groupBy("token", "next").agg(F.count("*").alias("n"))
    every = spark.range(_KINDS * _KINDS).select((F.col("id") / _KINDS).cast("int").alias("token"), (F.col("id") % _KINDS).cast("int").alias("next"))
    counts = every.join(n, ["token", "next"], "left").select("token", "next", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    totals = counts.groupBy("token").agg(F.sum("n").alias("all"))
    return counts.join(totals, "token").select(F.col("token").alias("last"), F.col("next").alias("token"), F.log(F.col("n") / F.col("all")).alias("score"))


def favoured(scorer):
    """Each batch likes some tokens better: a hundredth for each unit of a number made from both."""

    def scored(beams: DataFrame) -> DataFrame:
        return scorer(beams).withColumn("score", F.col("score") - (F.col("batch") * 7 + F.col("token") * 13) % 17 / 20)

    return scored


@query("decode_beam_search")
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three beams from each customer's token, six steps at most."""
    starts = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("batch"), F.array((2 + F.col("c_custkey") % 10).cast("int")).alias("tokens"))
    found = B.beam_search(starts, favoured(B.table_scorer(F.broadcast(transitions(spark, sf_dir)))), 3, 7, _EOS, length_penalty=0.8, keep=2)
    return found.select("batch", "place", F.array_join("tokens", " ").alias("tokens"), F.round("score", 9).alias("score"))


def _chance(i: str, what: int) -> str:
    return _hashed(f"(key * 4096 + {i}) % 2147483648", 5 + what)


@query(
    "tokens_permuted",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE len(text) > 0),
b AS (SELECT doc_id * 1024 + j AS key, [1] || [(length(x) * 7 + ascii(x)) % 1000 + 10 FOR x IN w[30 * j + 1:30 * j + 30]] || [2] AS ids FROM w, range(0, (len(w) + 29) // 30) r(j)),
p AS (SELECT key, ids || [0 FOR i IN range(32 - len(ids))] AS ids FROM b),
d AS (SELECT key, k, floor({_chance("k", 1)} * 5)::BIGINT + 1 AS size FROM p, range(0, 7) t(k)),
c AS (SELECT key, k, size, floor(size / (1 / 6.0) + 1e-9)::BIGINT AS context FROM d),
s AS (SELECT key, size, start + floor({_chance("k", 2)} * (context - size + 1))::BIGINT AS at FROM (SELECT *, sum(context) OVER (PARTITION BY key ORDER BY k) - context AS start FROM c) WHERE start < 32),
e AS (SELECT key, unnest(range(0, 32)) AS i, unnest(ids) AS x FROM p),
m AS (SELECT e.key, e.i, e.x, e.x >= 10 AND bool_or(coalesce(e.i >= s.at AND e.i < s.at + s.size, false)) AS masked FROM e JOIN s USING (key) GROUP BY key, i, x),
o AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY {_chance("t", 3)}, t) - 1 AS slot, t FROM p, range(0, 16) y(t)),
q AS (SELECT key, i, x, masked, CASE WHEN NOT masked AND x >= 10 THEN -1 ELSE o.t + CASE WHEN i >= 16 THEN 16 ELSE 0 END END AS place FROM m JOIN o USING (key) WHERE o.slot = i % 16),
h AS (SELECT a.key, sum(a.i * 37 + c.i) AS hidden FROM q a JOIN q c ON a.key = c.key AND a.place <= c.place AND c.masked GROUP BY 1)
SELECT key, sum(masked::INT)::INT AS masked, string_agg(CASE WHEN masked THEN 3 ELSE x END, ' ' ORDER BY i) AS inputs, string_agg(place, ' ' ORDER BY i) AS places, coalesce(any_value(hidden), 0)::BIGINT AS hidden
FROM q LEFT JOIN h USING (key) GROUP BY key""",
)
def permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 30 words between marks, padded to 32, of all documents; hidden adds up who may not see whom."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", words.alias("w")).where("size(w) > 0")
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 30).cast("int"))).alias("j"))
    ids = F.concat(F.array(F.lit(1)), F.transform(F.slice("w", F.col("j") * 30 + 1, 30), lambda x: (F.char_length(x) * 7 + F.ascii(x)) % 1000 + 10), F.array(F.lit(2)))
    rows = rows.select((F.col("doc_id") * 1024 + F.col("j")).alias("key"), F.concat(ids, F.array_repeat(F.lit(0), 32 - F.size(ids))).alias("ids"))
    rows = rows.select("key", P.permuted(F.col("ids"), F.col("key"), 3, [0, 1, 2], seed=5).alias("p")).select("key", "p.*")
    rows = rows.withColumn("mask", P.permutation_mask(F.col("places"), F.col("masked")))
    mask = F.col("mask")
    hidden = F.aggregate(F.flatten(F.transform(mask, lambda r, i: F.transform(r, lambda x, j: x * (i * 37 + j)))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select("key", F.size(F.filter("masked", lambda m: m)).alias("masked"), joined("inputs").alias("inputs"), joined("places").alias("places"), hidden.alias("hidden"))
