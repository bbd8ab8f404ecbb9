"""Token arrays, masks, spans, splits and decoding; token ids are made of words' lengths and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions import vectors as V
from ..functions.text import whitespace_tokens
from ..operators import decoding as D
from ..operators import splits as S
from ._registry import query, read, spread

M = 4294967296
# Token ids: the length of each word, up to 99.
IDS = r"t AS (SELECT doc_id, [least(len(w), 99) FOR w IN regexp_extract_all(text, '[^ \t-\r]+')] AS ids FROM documents)"


def h_sql(key: str, seed: int = 0) -> str:
    first = f"((({key})::BIGINT + {seed}) * {K.MULTIPLIER} % {M})"
    return f"((({first} >> 7) * {2246822519 % (1 << 31)} + {first}) % {M})"


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = whitespace_tokens(F.col("text"))
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.transform(words, lambda w: F.least(F.char_length(w), F.lit(99))).alias("ids"))


def flat(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(
    "tokens_truncated_pair",
    f"""WITH {IDS}, p AS (SELECT doc_id, ids AS a, ids[1:doc_id % 50] AS b FROM t), n AS (SELECT *, len(a) AS n, len(b) AS m, greatest(0, len(a) + len(b) - 40) AS over FROM p),
g AS (SELECT *, least(over, abs(n - m)) AS f FROM n), c AS (SELECT *, over - f AS r FROM g)
SELECT doc_id, (n - (CASE WHEN n > m THEN f ELSE 0 END + r // 2))::INT AS n_a, (m - (CASE WHEN m > n THEN f ELSE 0 END + (r + 1) // 2))::INT AS n_b FROM c""",
)
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = K.truncated_pair(F.col("ids"), F.slice(F.col("ids"), F.lit(1), (F.col("doc_id") % 50).cast("int")), 40)
    return ids(spark, sf_dir).select("doc_id", F.size(a).alias("n_a"), F.size(b).alias("n_b"))


@query("tokens_blocks", f"WITH {IDS} SELECT doc_id, b::INT AS block, list_sum(ids[b * 64 + 1 : b * 64 + 64])::BIGINT AS total FROM (SELECT doc_id, ids, unnest(range(len(ids) // 64)) AS b FROM t)")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids(spark, sf_dir).select("doc_id", F.posexplode(K.blocks(F.col("ids"), 64)).alias("block", "b"))
    return rows.select("doc_id", "block", V.total(V.doubles(F.col("b"))).cast("bigint").alias("total"))


@query(
    "tokens_spans",
    f"""WITH {IDS}, s AS (SELECT doc_id, ids, k * 48 AS start FROM (SELECT doc_id, ids, unnest(range(len(ids) // 48 + 1)) AS k FROM t) WHERE k = 0 OR (k - 1) * 48 + 128 < len(ids))
SELECT doc_id, start::INT AS start, len(ids[start + 1 : start + 128])::INT AS n, coalesce(list_sum(ids[start + 1 : start + 128]), 0)::BIGINT AS total FROM s""",
)
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids(spark, sf_dir).select("doc_id", F.inline(K.spans(F.col("ids"), 128, 48)))
    return rows.select("doc_id", "start", F.size("tokens").alias("n"), V.total(V.doubles(F.col("tokens"))).cast("bigint").alias("total"))


CHANCE = f"{{}} / {float(M)}::DOUBLE"


def _drawn(what: int) -> str:
    return f"{h_sql(f'(doc_id * 4096 + i) % {1 << 31}', what)} / {float(M)}::DOUBLE"


# Whole texts: every word in one of as many blocks as it takes (the last may be short).  Each query has two names.
_ASSEMBLED = f"WITH {IDS}, b AS (SELECT doc_id, ids, unnest(range(0, greatest(len(ids), 1)::BIGINT, 30)) AS start FROM t WHERE ids IS NOT NULL), s AS (SELECT doc_id, start, [101] || ids[start + 1 : start + 30] || [102] AS a FROM b) SELECT doc_id, start::INT AS start, array_to_string(a || list_transform(range(32 - len(a)), lambda i: 0), ',') AS input_ids, len(a)::INT AS n FROM s"


@query("tokens_assembled", _ASSEMBLED)
@query("tokens_assembled_whole", _ASSEMBLED)
def assembled_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids(spark, sf_dir).select("doc_id", F.inline(K.spans(F.col("ids"), 30, 30)))
    a, types = K.assembled(F.col("tokens"), None, 101, 102)
    f = K.features(a, types, 32)
    return rows.select("doc_id", "start", flat(f["input_ids"]).alias("input_ids"), V.total(V.doubles(f["attention_mask"])).cast("int").alias("n"))


_NGRAMS = f"WITH {IDS}, i AS (SELECT ids, unnest(range(1, len(ids) - 1)) AS i FROM t), g AS (SELECT ids[i : i + 2] AS g FROM i) SELECT array_to_string(g, ' ') AS gram, count(*) AS n FROM g GROUP BY 1"


@query("tokens_ngrams", _NGRAMS)
@query("tokens_ngrams_whole", _NGRAMS)
def ngrams_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids(spark, sf_dir).select(F.explode(K.ngrams(F.col("ids"), 3)).alias("g"))
    return rows.groupBy(F.array_join(F.transform("g", lambda x: x.cast("string")), " ").alias("gram")).agg(F.count("*").alias("n"))


_MASKED = f"""WITH {IDS}, e AS (SELECT doc_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM t),
d AS (SELECT doc_id, i, x, {_drawn(1)} < 0.15 AND x <> 1 AS chosen, {_drawn(2)} AS how, floor({_drawn(3)} * 100)::INT AS other FROM e)
SELECT doc_id, i::INT AS pos, CASE WHEN chosen AND how < 0.8 THEN 103 WHEN chosen AND how < 0.9 THEN other ELSE x END::INT AS input_id, CASE WHEN chosen THEN x ELSE -100 END::INT AS label FROM d"""


@query("tokens_masked", _MASKED)
@query("tokens_masked_whole", _MASKED)
def masked_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, labels = K.masked(F.col("ids"), F.col("doc_id"), 103, 100, [1])
    rows = ids(spark, sf_dir).select("doc_id", F.posexplode(F.arrays_zip(new.alias("i"), labels.alias("label"))).alias("pos", "z"))
    names = rows.schema["z"].dataType.names
    return rows.select("doc_id", "pos", F.col("z").getField(names[0]).cast("int").alias("input_id"), F.col("z").getField(names[1]).cast("int").alias("label"))


@query(
    "tokens_unmasked",
    f"WITH {IDS}, u AS (SELECT doc_id, [CASE WHEN x % 3 = 0 THEN 7 ELSE x END FOR x IN ids] AS a FROM t) SELECT doc_id, coalesce(list_sum(a), 0)::BIGINT AS total FROM u",
)
def unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.transform("ids", lambda x: F.when(x % 3 == 0, 7).otherwise(-1))
    return ids(spark, sf_dir).select("doc_id", V.total(V.doubles(K.unmasked(F.col("ids"), labels))).cast("bigint").alias("total"))


# Scores of 64 tokens: a vector.
L = "l AS (SELECT vec_id, unnest(embedding)::DOUBLE * 4 AS logit, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("v"))
    return D.exploded(rows, "vec_id", "v")


P = "p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l))"


@query("decode_softmax", f"WITH {L}, {P} SELECT vec_id, token::INT AS token, round(p, 9) AS p FROM p")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.softmaxed(logits(spark, sf_dir), "vec_id").select("vec_id", "token", F.round("p", 9).alias("p"))


@query("decode_top_k", f"WITH {L} SELECT vec_id, token::INT AS token, round(logit, 6) AS logit FROM l QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 8")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_k_filtered(logits(spark, sf_dir), "vec_id", 8).where("logit > double('-Infinity')").select("vec_id", "token", F.round("logit", 6).alias("logit"))


@query(
    "decode_top_p",
    f"""WITH {L}, {P}, b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS n FROM p) SELECT vec_id, token::INT AS token FROM b WHERE before <= 0.8 OR n <= 2""",
)
def top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_p_filtered(logits(spark, sf_dir), "vec_id", 0.8, 2).where("logit > double('-Infinity')").select("vec_id", "token")


@query(
    "decode_processors",
    f"""WITH {L}, g AS (SELECT DISTINCT vec_id, ((vec_id + k) * 7) % 64 AS token FROM embeddings, range(5) r(k)),
r AS (SELECT l.vec_id, l.token, CASE WHEN g.token IS NULL THEN logit WHEN logit < 0 THEN logit * 1.5 ELSE logit / 1.5 END / 0.7 AS logit FROM l LEFT JOIN g ON g.vec_id = l.vec_id AND g.token = l.token)
SELECT vec_id, token::INT AS token, round(logit, 6) AS logit FROM r WHERE NOT (vec_id % 10 < 5 AND token = 3)""",
)
def processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    generated = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("vec_id", (((F.col("vec_id") + F.col("k")) * 7) % 64).cast("int").alias("token"))
    out = D.temperature(D.repetition_penalty(rows, generated, "vec_id", 1.5), 0.7).withColumn("length", F.col("vec_id") % 10)
    return D.min_length(out, "length", 5, 3).where("logit > double('-Infinity')").select("vec_id", "token", F.round("logit", 6).alias("logit"))


@query(
    "decode_banned_ngrams",
    r"""WITH t AS (SELECT doc_id, [least(len(w), 99) % 10 FOR w IN regexp_extract_all(text, '[^ \t-\r]+')] AS s FROM documents)
SELECT DISTINCT doc_id, s[i + 2]::INT AS token FROM (SELECT doc_id, s, unnest(range(1, len(s)::BIGINT)) AS i FROM t) WHERE i + 2 <= len(s) AND s[i] = s[-2] AND s[i + 1] = s[-1]""",
)
def banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids(spark, sf_dir).select("doc_id", F.posexplode(F.transform("ids", lambda x: x % 10)).alias("pos", "token"))
    return D.banned_ngrams(rows, "doc_id", 3)


@query(
    "decode_beam_step",
    f"""WITH {L}, c AS (SELECT label AS batch, l.vec_id AS beam, token, logit AS score FROM l JOIN embeddings e ON e.vec_id = l.vec_id),
b AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, beam, token) - 1 AS rank FROM c QUALIFY rank < 16),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY rank) - 1 AS slot FROM b WHERE token <> 5)
SELECT 'next' AS kind, batch, beam, token::INT AS token, slot::INT AS place FROM o WHERE slot < 8 UNION ALL SELECT 'ended', batch, beam, token::INT, rank::INT FROM b WHERE token = 5 AND rank < 8""",
)
def beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("beam"), F.col("label").alias("batch"))
    c = logits(spark, sf_dir).select(F.col("vec_id").alias("beam"), "token", F.col("logit").alias("score")).join(label, "beam")
    on, ended = D.beam_step(c, 8, 5)
    a = on.select(F.lit("next").alias("kind"), "batch", "beam", "token", F.col("slot").alias("place"))
    return a.union(ended.select(F.lit("ended").alias("kind"), "batch", "beam", "token", F.col("rank").alias("place")))


@query(
    "decode_hypotheses",
    """SELECT label AS batch, vec_id AS beam, row_number() OVER (PARTITION BY label ORDER BY round(list_sum(embedding::DOUBLE[]), 9) / pow(1 + vec_id % 7, 0.6) DESC, vec_id) AS place FROM embeddings QUALIFY place <= 4""",
)
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("batch"), F.col("vec_id").alias("beam"), F.lit(0).alias("token"), (1 + F.col("vec_id") % 7).alias("length"), F.round(V.total(V.doubles(F.col("embedding"))), 9).alias("score"))
    return D.best_hypotheses(rows, 4, 0.6).select("batch", "beam", F.col("place").cast("bigint").alias("place"))


@query(
    "decode_answer_spans",
    f"""WITH {L}, s AS (SELECT vec_id, token AS pos, logit AS s, sin(token * 3 + vec_id) AS e FROM l), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pos) <= 10),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, pos) <= 10)
SELECT a.vec_id, a.pos::INT AS start_at, b.pos::INT AS end_at, row_number() OVER (PARTITION BY a.vec_id ORDER BY a.s + b.e DESC, a.pos, b.pos)::INT AS rank FROM a JOIN b ON a.vec_id = b.vec_id AND b.pos >= a.pos AND b.pos - a.pos < 15 QUALIFY rank <= 5""",
)
def answer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir).select("vec_id", F.col("token").alias("pos"), F.col("logit").alias("start"), F.sin((F.col("token") * 3 + F.col("vec_id")).cast("double")).alias("end"))
    return D.answer_spans(rows, "vec_id", 10, 15, 5).select("vec_id", "start_at", "end_at", "rank")


SPLIT = f"CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.6 + (1 - 0.6) * 0.5 THEN 'val' ELSE 'test' END"
U = f"{h_sql('c_custkey', 1)} / {float(M)}::DOUBLE"


@query("split_random", f"SELECT c_custkey, {SPLIT} AS split FROM (SELECT c_custkey, {U} AS u FROM customer)")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", S.split_of(F.col("c_custkey")).alias("split"))


@query(
    "split_without_overlap",
    f"""WITH s AS (SELECT c_custkey, c_custkey % 97 AS item, {SPLIT} AS split FROM (SELECT c_custkey, {U} AS u FROM customer)),
b AS (SELECT item, min(CASE split WHEN 'train' THEN 2 WHEN 'val' THEN 1 ELSE 0 END) AS b FROM s GROUP BY 1) SELECT c_custkey, CASE b WHEN 2 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM s JOIN b USING (item)""",
)
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 97).alias("item"), S.split_of(F.col("c_custkey")).alias("split"))
    return S.without_overlap(rows, "item", method="low_priority").select("c_custkey", "split")


@query("split_capped", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' OR true QUALIFY c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR row_number() OVER (PARTITION BY c_mktsegment ORDER BY {h_sql('c_custkey', 1)}, c_custkey) <= 25")
def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.capped(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", {"BUILDING": 25, "MACHINERY": 25}).select("c_custkey", "c_mktsegment")


@query("sample_shuffled", f"SELECT c_custkey, row_number() OVER (ORDER BY {h_sql('c_custkey', 1)}, c_custkey) - 1 AS place FROM customer")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shuffled(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", "place")


@query("sample_folds", f"SELECT c_custkey, ({h_sql('c_custkey', 1)} % 5)::INT AS fold FROM customer")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.folds(read(spark, sf_dir, "customer"), "c_custkey", 5).select("c_custkey", "fold")


@query(
    "sample_negatives",
    f"""WITH r AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS nth FROM part), n AS (SELECT count(*) AS n FROM part),
d AS (SELECT nth, (nth + 1 + {h_sql('nth', 1)} % (n - 1)) % n AS at FROM r, n) SELECT d.nth, r.p_name AS other FROM d JOIN r ON r.nth = d.at""",
)
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequences import numbered

    rows = numbered(read(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"])
    return S.negatives(rows.select("nth", "p_name"), "nth", "p_name").select("nth", "other")


@query("sample_shards", "WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS nth, s_suppkey, count(*) OVER () AS n FROM supplier), c AS (SELECT *, ceil(n / 7)::BIGINT AS size FROM r), a AS (SELECT nth, s_suppkey, size FROM c UNION ALL SELECT nth + n, s_suppkey, size FROM c WHERE nth < 7 * size - n) SELECT nth, s_suppkey, (nth // size)::INT AS shard FROM a")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequences import numbered

    return S.shards(numbered(read(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"]), "nth", 7).select("nth", "s_suppkey", "shard")


@query("batches", "SELECT (nth // 16) AS batch, array_to_string(list(n_name ORDER BY nth), ',') AS names FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS nth FROM nation) GROUP BY 1")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequences import batched, numbered

    rows = numbered(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return batched(rows, "nth", 16, "n_name").select("batch", F.array_join("values", ",").alias("names"))
