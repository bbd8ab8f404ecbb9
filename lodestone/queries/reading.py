"""Extractive question answering and encoded pairs, on benchmark passages, documents' token ids and vectors as logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reading as R
from ..functions import tokens as K
from ..functions import vectors as V
from ..functions.text import basic_tokens
from ..operators import answers as A
from ._registry import query, read
from .text import norm_sql
from .tokens import IDS, L, flat, ids, logits

G = "[^ \\t\\r\\n\\x{202f}]+"
CUT = "c AS (SELECT item_id, text, length(text) // 3 AS p, substr(text, length(text) // 3 + 1, 20) AS answer FROM benchmark)"


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage, a place a third into it, and the 20 characters from there."""
    third = F.floor(F.char_length("text") / 3).cast("int")
    return read(spark, sf_dir, "benchmark").select("item_id", "text", third.alias("p"), F.substring("text", third + 1, F.lit(20)).alias("answer"))


@query(
    "squad_word_offsets",
    f"""WITH {CUT}, w AS (SELECT item_id, text, answer, len(regexp_extract_all(substr(text, 1, p + 1), '{G}')) - 1 AS first, len(regexp_extract_all(substr(text, 1, least(p + length(answer) - 1, length(text) - 1)::INT + 1), '{G}')) - 1 AS last, regexp_extract_all(text, '{G}') AS t FROM c)
SELECT item_id, first::INT AS first, last::INT AS last, len(t)::INT AS n, contains(array_to_string(t[first + 1 : last + 1], ' '), array_to_string(regexp_extract_all(answer, '[^ \\t-\\r]+'), ' ')) AS held FROM w""",
)
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cut(spark, sf_dir).withColumn("w", R.answer_words(F.col("text"), F.col("p"), F.col("answer")))
    held = R.holds_answer(F.col("text"), F.col("w.first"), F.col("w.last"), F.col("answer"))
    return rows.select("item_id", "w.first", "w.last", F.size(R.context_words(F.col("text"))).alias("n"), held.alias("held"))


@query(
    "squad_improved_span",
    f"""WITH w AS (SELECT item_id, regexp_extract_all(text, '{G}') AS t FROM benchmark), a AS (SELECT item_id, t, array_to_string(t[6:7], ' ') AS answer, 3 AS first, least(9, len(t) - 1) AS last FROM w WHERE len(t) > 3),
c AS (SELECT item_id, s, e FROM a, range(3, 10) x(s), range(3, 10) y(e) WHERE s <= e AND e <= last AND array_to_string(t[s + 1 : e + 1], ' ') = answer QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s, e DESC) = 1)
SELECT a.item_id, coalesce(s, first)::INT AS first, coalesce(e, last)::INT AS last FROM a LEFT JOIN c USING (item_id)""",
)
def improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", R.context_words(F.col("text")).alias("t")).where(F.size("t") > 3)
    span = R.improved_span(F.col("t"), F.lit(3), F.least(F.lit(9), F.size("t") - 1), F.array_join(F.slice("t", 6, 2), " "))
    return rows.select("item_id", span.alias("s")).select("item_id", "s.first", "s.last")


BASIC = r"regexp_extract_all(strip_accents(lower({s})), '[!-/:-@\[-`{{-~\pP]|[^ \t-\r\p{{Zs}}!-/:-@\[-`{{-~\pP]+')"


@query(
    "squad_final_text",
    rf"""WITH w AS (SELECT item_id, regexp_extract_all(text, '{G}') AS t FROM benchmark), o AS (SELECT item_id, array_to_string(t, ' ') AS original, {BASIC.format(s="array_to_string(t, ' ')")} AS b FROM w),
p AS (SELECT *, array_to_string(b[4:9], ' ') AS pred, array_to_string(b, ' ') AS tokens FROM o), a AS (SELECT *, instr(tokens, pred) AS place, length(replace(substr(tokens, 1, greatest(instr(tokens, pred) - 1, 0)), ' ', '')) AS before,
list_filter(range(1, length(original) + 1), lambda i: substr(original, i, 1) <> ' ') AS places FROM p)
SELECT item_id, CASE WHEN place = 0 OR length(replace(tokens, ' ', '')) <> length(replace(original, ' ', '')) OR length(replace(pred, ' ', '')) = 0 THEN original
ELSE substr(original, places[before + 1], places[before + length(replace(pred, ' ', ''))] - places[before + 1] + 1) END AS answer FROM a""",
)
def final_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.array_join(R.context_words(F.col("text")), " ").alias("original"))
    pred = F.array_join(F.slice(basic_tokens(F.col("original")), 4, 6), " ")
    return rows.select("item_id", R.final_text(pred, F.col("original")).alias("answer"))


SPANS = "s AS (SELECT doc_id, start, len(ids[start + 1 : start + 128]) AS n FROM (SELECT doc_id, ids, unnest(range(0, greatest(len(ids), 1)::BIGINT, 48)) AS start FROM t) WHERE start = 0 OR start - 48 + 128 < len(ids))"


@query(
    "squad_max_context",
    f"""WITH {IDS}, {SPANS}, e AS (SELECT doc_id, start, n, unnest(range(start, start + n)) AS pos FROM s),
b AS (SELECT doc_id, pos, arg_max(start, (least(pos - start, start + n - 1 - pos) + 0.01::DOUBLE * n, -start)) AS start FROM e GROUP BY 1, 2)
SELECT doc_id, start::INT AS start, count(*) AS n, min(pos)::INT AS first, max(pos)::INT AS last FROM b GROUP BY 1, 2""",
)
def max_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = ids(spark, sf_dir).select("doc_id", F.inline(K.spans(F.col("ids"), 128, 48))).select("doc_id", "start", F.size("tokens").alias("n")).where("n > 0")
    return A.max_context(spans, "doc_id").groupBy("doc_id", "start").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


FEATURES = f"""{IDS}, q AS (SELECT doc_id, ids[1:5] AS question, ids AS context, len(ids) // 3 AS first, least(len(ids) // 3 + 3, len(ids) - 1) AS last, 128 - len(ids[1:5]) - 3 AS room FROM t WHERE len(ids) > 0),
s AS (SELECT *, unnest(range(0, len(context)::BIGINT, 48)) AS doc_start FROM q), f AS (SELECT *, context[doc_start + 1 : doc_start + room] AS part, len(question) + 2 AS off FROM s WHERE doc_start = 0 OR doc_start - 48 + room < len(context)),
g AS (SELECT *, first >= doc_start AND last < doc_start + len(part) AS inside FROM f)"""


@query(
    "squad_span_features",
    f"""WITH {FEATURES} SELECT doc_id, doc_start::INT AS doc_start, array_to_string([101] || question || [102] || part || [102], ',') AS input_ids, (len(question) + 2)::BIGINT AS masked,
(CASE WHEN inside THEN first - doc_start + off ELSE 0 END)::INT AS start, (CASE WHEN inside THEN last - doc_start + off ELSE 0 END)::INT AS "end", NOT inside AS is_impossible FROM g""",
)
def span_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("doc_id", "doc_start", flat(F.col("input_ids")).alias("input_ids"), V.total(V.doubles(F.col("p_mask"))).cast("bigint").alias("masked"), "start", "end", "is_impossible")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids(spark, sf_dir).where(F.size("ids") > 0)
    first = F.floor(F.size("ids") / 3).cast("int")
    features = R.span_features(F.slice("ids", 1, 5), F.col("ids"), first, F.least(first + 3, F.size("ids") - 1), 128, 48, 101, 102)
    return rows.select("doc_id", F.inline(features))


@query(
    "squad_model_inputs",
    f"""WITH {FEATURES} SELECT doc_id, doc_start::INT AS doc_start, (len(question) + len(part) + 3)::INT AS n_attended, (len(part) + 1)::BIGINT AS second_segment, 0 AS cls_index, (len(question) + 2)::BIGINT AS p_masked, CASE WHEN inside THEN 0 ELSE 1 END AS is_impossible,
(CASE WHEN inside THEN first - doc_start + off ELSE 0 END)::INT AS start_positions, (CASE WHEN inside THEN last - doc_start + off ELSE 0 END)::INT AS end_positions FROM g""",
)
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model of the kind that predicts unanswerable questions is given for training."""
    total = lambda c: V.total(V.doubles(F.col(c))).cast("bigint")
    rows = _features(spark, sf_dir).select("doc_id", "doc_start", R.padded(F.col("input_ids"), F.lit(128)).alias("p"), "token_type_ids", "p_mask", F.lit(0).alias("cls_index"), F.col("is_impossible").cast("int").alias("is_impossible"), F.col("start").alias("start_positions"), F.col("end").alias("end_positions"))
    return rows.select("doc_id", "doc_start", V.total(V.doubles(F.col("p.attention_mask"))).cast("int").alias("n_attended"), total("token_type_ids").alias("second_segment"), "cls_index", total("p_mask").alias("p_masked"), "is_impossible", "start_positions", "end_positions")


TOKENS = f"{L}, k AS (SELECT vec_id // 5 AS example, vec_id % 5 AS feature, token AS pos, logit AS s, sin(token * 3 + vec_id) AS e FROM l)"
NBEST = f"""{TOKENS}, a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY example, feature ORDER BY s DESC, pos) <= 10), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY example, feature ORDER BY e DESC, pos) <= 10),
c AS (SELECT a.example, a.feature, a.pos AS st, b.pos AS en, a.s + b.e AS score, 'w' || (a.pos % 8) || ' ' || (b.pos - a.pos) AS text FROM a JOIN b ON a.example = b.example AND a.feature = b.feature AND b.pos >= a.pos AND b.pos - a.pos < 15 WHERE a.pos > 0 AND b.pos > 0)"""
RANKED = """d AS (SELECT * FROM {c} QUALIFY row_number() OVER (PARTITION BY example, text ORDER BY score DESC, feature, st, en) = 1)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 5).alias("example"), (F.col("vec_id") % 5).alias("feature"), F.col("token").alias("pos"), F.col("logit").alias("start"), F.sin((F.col("token") * 3 + F.col("vec_id")).cast("double")).alias("end"))
    return rows.withColumn("usable", F.col("pos") > 0)


def _texts(found: DataFrame) -> DataFrame:
    text = F.concat(F.lit("w"), (F.col("start_at") % 8).cast("string"), F.lit(" "), (F.col("end_at") - F.col("start_at")).cast("string"))
    return found.withColumn("text", text)


def _n_best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _tokens(spark, sf_dir)
    examples = rows.where("pos = 0").groupBy("example").agg(F.min(F.col("start") + F.col("end")).alias("null_score"))
    return A.n_best_answers(_texts(A.candidates(rows, "example", 10, 15)), examples, "example", 5), examples


NULLS = f"""{NBEST}, z AS (SELECT example, min(s + e) AS null_score FROM k WHERE pos = 0 GROUP BY 1), {RANKED.format(c="c")}, u AS (SELECT example, text, score, feature, st, en, 0 AS nul FROM d UNION ALL SELECT example, '', null_score, 0, 0, 0, 1 FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY score DESC, feature, st, en, nul DESC) AS p FROM u QUALIFY p <= 5 OR nul = 1)"""


@query(
    "squad_n_best",
    f"WITH {NULLS}, x AS (SELECT example, text, score, p, exp(score - max(score) OVER (PARTITION BY example)) AS x FROM r) SELECT example, row_number() OVER (PARTITION BY example ORDER BY p)::INT AS place, text, round(score, 9) AS score, round(x / sum(x) OVER (PARTITION BY example), 9) AS probability FROM x",
)
def n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n_best(spark, sf_dir)[0].select("example", "place", "text", F.round("score", 9).alias("score"), F.round("probability", 9).alias("probability"))


@query(
    "squad_predictions",
    f"WITH {NULLS}, y AS (SELECT example, arg_min(text, p) AS text, arg_min(score, p) AS score FROM r WHERE text <> '' GROUP BY 1) SELECT example, CASE WHEN null_score - score > -2.5 THEN '' ELSE text END AS text, round(null_score - score, 9) AS score_diff FROM z JOIN y USING (example)",
)
def squad_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, examples = _n_best(spark, sf_dir)
    return A.predictions(best, examples, "example", -2.5).select("example", "text", F.round("score_diff", 9).alias("score_diff"))


@query(
    "squad_n_best_log_probs",
    f"""WITH {TOKENS}, a AS (SELECT example, feature, pos, s FROM k QUALIFY row_number() OVER (PARTITION BY example, feature ORDER BY s DESC, pos) <= 4), b AS (SELECT example, feature, pos, e FROM k QUALIFY row_number() OVER (PARTITION BY example, feature ORDER BY e DESC, pos) <= 6),
c AS (SELECT a.example, a.feature, a.pos AS st, b.pos AS en, a.s + (b.e - a.pos / 100.0::DOUBLE) AS score, 'w' || (a.pos % 8) || ' ' || (b.pos - a.pos) AS text FROM a JOIN b ON a.example = b.example AND a.feature = b.feature WHERE a.pos < 60 AND b.pos < 60 AND b.pos >= a.pos AND b.pos - a.pos < 15),
{RANKED.format(c="c")}, r AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY score DESC, feature, st, en) AS p FROM d QUALIFY p <= 5), e AS (SELECT example, p, text, score FROM r UNION ALL SELECT DISTINCT example, 1, 'empty', 0 FROM k WHERE example NOT IN (SELECT example FROM r)),
x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY example)) AS x FROM e) SELECT example, p::INT AS place, text, round(score, 9) AS score, round(x / sum(x) OVER (PARTITION BY example), 9) AS probability FROM x""",
)
def n_best_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four starts a feature, and for each of them six ends with log probabilities of their own."""
    rows = _tokens(spark, sf_dir).groupBy("example", "feature").agg(F.collect_list(F.struct("pos", "start", "end")).alias("t"))
    top = lambda c, n: F.transform(F.slice(F.array_sort(F.transform("t", lambda x: F.struct((-x[c]).alias("v"), x["pos"].alias("pos")))), 1, n), lambda x: F.struct(x["pos"].alias("index"), (-x["v"]).alias("log_prob")))
    rows = rows.select("example", "feature", top("start", 4).alias("start_top"), top("end", 6).alias("ends"), F.lit(60).alias("usable_to"))
    ends = F.transform("start_top", lambda s: F.transform("ends", lambda e: F.struct(e["index"].alias("index"), (e["log_prob"] - s["index"] / 100.0).alias("log_prob"))))
    found = _texts(A.candidates_of_tops(rows.withColumn("end_top", ends), "example", 15))
    best = A.n_best_answers(found, rows.select("example").distinct(), "example", 5)
    return best.select("example", "place", "text", F.round("score", 9).alias("score"), F.round("probability", 9).alias("probability"))


@query(
    "qa_decoded",
    f"""WITH {TOKENS}, m AS (SELECT * FROM k WHERE pos = 0 OR pos > 9), x AS (SELECT *, exp(s - max(s) OVER w) AS xs, exp(e - max(e) OVER w) AS xe FROM m WINDOW w AS (PARTITION BY example, feature)),
p AS (SELECT example, feature, pos, xs / sum(xs) OVER w AS ps, xe / sum(xe) OVER w AS pe FROM x WINDOW w AS (PARTITION BY example, feature)), n AS (SELECT example, min(ps * pe) AS score FROM p WHERE pos = 0 GROUP BY 1),
c AS (SELECT a.example, a.feature, a.pos AS st, b.pos AS en, a.ps * b.pe AS score FROM p a JOIN p b ON a.example = b.example AND a.feature = b.feature AND b.pos >= a.pos AND b.pos - a.pos < 15 WHERE a.pos > 0
QUALIFY row_number() OVER (PARTITION BY a.example, a.feature ORDER BY a.ps * b.pe DESC, a.pos, b.pos) <= 3), u AS (SELECT * FROM c UNION ALL SELECT example, -1, 0, 0, score FROM n)
SELECT example, row_number() OVER (PARTITION BY example ORDER BY score DESC, feature, st, en)::INT AS rank, feature, st::INT AS start_at, en::INT AS end_at, round(score, 9) AS score FROM u QUALIFY rank <= 3""",
)
def qa_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).withColumn("context", F.col("pos") > 9)
    best = A.best_decoded(A.decoded(rows, "example", 3, 15), "example", 3, impossible=True)
    return best.select("example", "rank", "feature", "start_at", "end_at", F.round("score", 9).alias("score"))


@query(
    "squad_best_of_golds",
    rf"""WITH b AS (SELECT item_id, text FROM benchmark), p AS (SELECT item_id, text FROM b WHERE item_id % 5 > 0), g AS (SELECT item_id, regexp_extract(text, '^\S+ \S+ \S+') AS answer FROM b WHERE item_id % 3 > 0 UNION ALL SELECT item_id, text || ' the end' FROM b WHERE item_id % 3 = 1 UNION ALL SELECT item_id, 'the a .' FROM b WHERE item_id % 3 = 2 UNION ALL SELECT item_id, NULL FROM b WHERE item_id % 3 = 0),
f AS (SELECT item_id, answer FROM g WHERE answer IS NOT NULL AND {norm_sql("answer")} <> ''), e AS (SELECT item_id, answer FROM f UNION ALL SELECT item_id, '' FROM b WHERE item_id NOT IN (SELECT item_id FROM f)),
n AS (SELECT e.item_id, row_number() OVER () AS i, {norm_sql("answer")} AS g, {norm_sql("text")} AS p FROM e JOIN p USING (item_id)), t AS (SELECT *, regexp_extract_all(g, '[^ ]+') AS gt, regexp_extract_all(p, '[^ ]+') AS pt FROM n),
o AS (SELECT i, sum(least(a, c))::DOUBLE AS same FROM (SELECT i, tok, count(*) AS a FROM (SELECT i, unnest(gt) AS tok FROM t) GROUP BY 1, 2) x JOIN (SELECT i, tok, count(*) AS c FROM (SELECT i, unnest(pt) AS tok FROM t) GROUP BY 1, 2) y USING (i, tok) GROUP BY 1)
SELECT item_id, item_id % 3 > 0 AS has_answer, max((g = p)::INT) AS exact, round(max(CASE WHEN len(gt) = 0 OR len(pt) = 0 THEN (len(gt) = len(pt))::INT ELSE 2 * coalesce(same, 0) / (len(gt) + len(pt)) END), 9) AS f1 FROM t LEFT JOIN o USING (i) GROUP BY 1, 2""",
)
def best_of_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    k = F.col("item_id") % 3
    golds = F.when(k == 0, F.array(F.lit(None).cast("string"))).when(k == 1, F.array(F.regexp_extract("text", r"^\S+ \S+ \S+", 0), F.concat("text", F.lit(" the end")))).otherwise(F.array(F.regexp_extract("text", r"^\S+ \S+ \S+", 0), F.lit("the a .")))
    found = A.squad_scores(b.select("item_id", F.explode(golds).alias("answer")), b.where("item_id % 5 > 0"), "item_id")
    return found.select("item_id", "has_answer", "exact", F.round("f1", 9).alias("f1"))


@query(
    "fill_mask",
    f"""WITH {L}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l), p AS (SELECT vec_id, token, e / sum(e) OVER (PARTITION BY vec_id) AS score FROM e)
SELECT 'best' AS kind, vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token)::INT AS rank, token::INT AS token, round(score, 9) AS score FROM p QUALIFY rank <= 5
UNION ALL SELECT 'targets', vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token)::INT, token::INT, round(score, 9) FROM p WHERE token IN (3, 8, 21)""",
)
def fill_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir)
    both = A.filled(rows, "vec_id", 5).withColumn("kind", F.lit("best")).union(A.filled(rows, "vec_id", 5, [3, 8, 21]).withColumn("kind", F.lit("targets")))
    return both.select("kind", "vec_id", "rank", "token", F.round("score", 9).alias("score"))


@query(
    "qa_span_to_answer",
    """WITH w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark), e AS (SELECT item_id, text, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w), t AS (SELECT *, (length(word) + 3) // 4 AS n FROM e),
p AS (SELECT *, coalesce(sum(n) OVER v, 0) AS token, coalesce(sum(length(word) + 1) OVER v, 0) AS c FROM t WINDOW v AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT item_id, max(token) FILTER (token <= 6) AS st, max(token) FILTER (token <= 14) AS en FROM p GROUP BY 1)
SELECT item_id, string_agg(word, ' ' ORDER BY i) AS answer, coalesce(min(c) FILTER (token = st), 0)::INT AS start, least(any_value(length(text)), coalesce(max(c + length(word)) FILTER (token = en), 0))::INT AS "end" FROM p JOIN k USING (item_id) WHERE token BETWEEN st AND en GROUP BY 1""",
)
def answer_of_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words have a token for each four characters; the span begins and ends with words."""
    pieces = F.transform(F.split("text", " "), lambda w: F.floor((F.char_length(w) + 3) / 4).cast("int"))
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text", pieces.alias("pieces"))
    starts = F.transform("pieces", lambda _, i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda s, x: s + x))
    at = lambda most: F.array_max(F.filter(starts, lambda t: t <= most))
    return rows.select("item_id", R.span_to_answer(F.col("text"), F.col("pieces"), at(6), at(14)).alias("a")).select("item_id", "a.*")


PAIR = f"{IDS}, p AS (SELECT doc_id, ids AS a, ids[3 : doc_id % 50 + 2] AS b FROM t)"
_LONGEST = """o AS (SELECT doc_id, a, b, len(a) AS n, len(b) AS m, greatest(0, len(a) + len(b) - 40) AS k FROM p), g AS (SELECT *, least(k, abs(n - m)) AS gap FROM o), h AS (SELECT *, (CASE WHEN n > m THEN gap ELSE 0 END + (k - gap) // 2) AS ca, (CASE WHEN m > n THEN gap ELSE 0 END + (k - gap + 1) // 2) AS cb,
CASE WHEN k = 0 THEN [] WHEN gap > 0 AND n > m THEN a[greatest(n - 2, 1):] ELSE b[greatest(m - 2, 1):] END AS lead FROM g)"""


@query(
    "tokens_truncated_with_overflow",
    f"""WITH {PAIR}, {_LONGEST}, i AS (SELECT doc_id, 'longest_first' AS strategy, a[1:n - ca] AS a, b[1:m - cb] AS b,
lead || list_transform(range(1, greatest(k, 1)::BIGINT), lambda i: CASE WHEN i < gap THEN CASE WHEN n > m THEN a[n - i] ELSE b[m - i] END WHEN (i - gap) % 2 = 1 THEN a[n - CASE WHEN n > m THEN gap ELSE 0 END - (i - gap) // 2] ELSE b[m - CASE WHEN m > n THEN gap ELSE 0 END - (i - gap) // 2] END) AS over FROM h
UNION ALL SELECT doc_id, 'only_first', CASE WHEN k > 0 AND n > k THEN a[1:n - k] ELSE a END, b, CASE WHEN k > 0 AND n > k THEN a[greatest(n - least(n, k + 2) + 1, 1):] ELSE [] END FROM o
UNION ALL SELECT doc_id, 'only_second', a, CASE WHEN k > 0 AND m > k THEN b[1:m - k] ELSE b END, CASE WHEN k > 0 AND m > k THEN b[greatest(m - least(m, k + 2) + 1, 1):] ELSE [] END FROM o)
SELECT doc_id, strategy, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b, array_to_string(over, ',') AS overflow FROM i""",
)
def truncated_with_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids(spark, sf_dir).select("doc_id", F.col("ids").alias("a"), F.slice("ids", F.lit(3), (F.col("doc_id") % 50).cast("int")).alias("b"))
    remove = F.size("a") + F.size("b") - 40
    each = [F.struct(F.lit(s).alias("strategy"), R.truncated(F.col("a"), F.col("b"), remove, s, 2).alias("t")) for s in ("longest_first", "only_first", "only_second")]
    rows = rows.select("doc_id", F.inline(F.array(*each)))
    return rows.select("doc_id", "strategy", *[flat(F.col(f"t.{c}")).alias(c) for c in ("a", "b", "overflow")])


@query(
    "tokens_padded_batches",
    f"""WITH {IDS}, b AS (SELECT doc_id, piece::INT AS piece, doc_id // 8 AS batch, ids[200 * piece + 1:200 * piece + 200] AS ids FROM t, range(0, (len(ids) + 199) // 200) r(piece)), w AS (SELECT *, ceil(max(len(ids)) OVER (PARTITION BY batch, piece) / 8)::INT * 8 AS width FROM b)
SELECT doc_id, piece, array_to_string(CASE WHEN batch % 2 = 0 THEN ids || list_transform(range(width - len(ids)), lambda i: 0) ELSE list_transform(range(width - len(ids)), lambda i: 0) || ids END, ',') AS input_ids, len(ids)::BIGINT AS attended, (width - len(ids))::BIGINT AS special, CASE WHEN batch % 2 = 0 OR width = len(ids) THEN 1 ELSE 0 END AS first_attended FROM w WHERE len(ids) > 0""",
)
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of 200 tokens (the model's length), padded to the longest of a batch of eight and a multiple of eight."""
    from pyspark.sql import Window

    batch = F.floor(F.col("doc_id") / 8)
    rows = ids(spark, sf_dir).where(F.size("ids") > 0).select("doc_id", batch.alias("batch"), "ids", F.explode(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / 200).cast("int"))).alias("piece"))
    rows = rows.withColumn("ids", F.slice("ids", 200 * F.col("piece") + 1, F.lit(200)))
    rows = rows.withColumn("width", F.max(F.size("ids")).over(Window.partitionBy("batch", "piece")))
    p = F.when(F.col("batch") % 2 == 0, R.padded(F.col("ids"), F.col("width"), multiple=8)).otherwise(R.padded(F.col("ids"), F.col("width"), left=True, multiple=8))
    total = lambda c: V.total(V.doubles(F.col(c))).cast("bigint")
    return rows.select("doc_id", "piece", p.alias("p")).select("doc_id", "piece", flat(F.col("p.input_ids")).alias("input_ids"), total("p.attention_mask").alias("attended"), total("p.special_tokens_mask").alias("special"), F.get("p.attention_mask", F.lit(0)).alias("first_attended"))


@query(
    "tokens_offset_lookups",
    rf"""WITH w AS (SELECT item_id, text, length(text) // 2 AS c, regexp_extract_all(text, '{G}') AS t FROM benchmark), e AS (SELECT item_id, text, c, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS i FROM w),
s AS (SELECT *, i + coalesce(sum(length(word)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT item_id, max(i) FILTER (start <= c AND c < start + length(word))::INT AS token, max(start) FILTER (i = 3)::INT AS start, max(start + length(word)) FILTER (i = 3)::INT AS "end", 6 AS first, 9 AS past FROM s WHERE text = array_to_string(regexp_extract_all(text, '{G}'), ' ') GROUP BY 1 HAVING count(*) > 9""",
)
def offset_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with single spaces; three tokens a word stand for its pieces."""
    rows = read(spark, sf_dir, "benchmark").where(F.col("text") == F.array_join(R.context_words(F.col("text")), " ")).where(F.size(R.context_words(F.col("text"))) > 9)
    rows = rows.select("item_id", "text", R.token_offsets(F.col("text")).alias("o"))
    words = F.flatten(F.transform("o", lambda _, i: F.array_repeat(i, 3)))
    span = R.word_to_tokens(words, F.lit(2))
    at = R.char_to_token(F.col("o"), F.floor(F.char_length("text") / 2).cast("int"))
    chars = R.token_to_chars(F.col("o"), F.lit(3))
    return rows.select("item_id", at.alias("token"), chars["start"].alias("start"), chars["end"].alias("end"), span["start"].alias("first"), span["end"].alias("past"))


@query(
    "tokens_offset_words",
    rf"""WITH w AS (SELECT item_id, text, length(text) // 2 AS c, regexp_extract_all(text, '{G}') AS t FROM benchmark), e AS (SELECT item_id, text, c, len(t) AS n, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS i FROM w),
s AS (SELECT *, i + coalesce(sum(length(word)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT item_id, (max(i) FILTER (start <= c AND c < start + length(word)) // 2)::INT AS word, max(start) FILTER (i = 4)::INT AS start, max(start + length(word)) FILTER (i = 5)::INT AS "end", ((max(n) - 1) // 2)::INT AS last FROM s WHERE text = array_to_string(regexp_extract_all(text, '{G}'), ' ') GROUP BY 1 HAVING count(*) > 9""",
)
def offset_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with single spaces, of which two tokens are a word."""
    rows = read(spark, sf_dir, "benchmark").where(F.col("text") == F.array_join(R.context_words(F.col("text")), " ")).where(F.size(R.context_words(F.col("text"))) > 9)
    rows = rows.select("item_id", "text", R.token_offsets(F.col("text")).alias("o")).withColumn("w", F.transform("o", lambda _, i: F.floor(i / 2).cast("int")))
    chars = R.word_to_chars(F.col("o"), F.col("w"), F.lit(2))
    at = R.char_to_word(F.col("o"), F.col("w"), F.floor(F.char_length("text") / 2).cast("int"))
    return rows.select("item_id", at.alias("word"), chars["start"].alias("start"), chars["end"].alias("end"), R.token_to_word(F.col("w"), F.lit(-1)).alias("last"))


@query("squad_features_with_results", "SELECT vec_id // 5 AS example, (vec_id % 5)::INT AS feature, vec_id AS unique_id, round(embedding[1]::DOUBLE + embedding[2]::DOUBLE, 8) AS null_score FROM embeddings")
def features_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    features = rows.select(F.floor(F.col("vec_id") / 5).alias("example"), F.col("vec_id").alias("unique_id"))
    results = rows.select(F.col("vec_id").alias("unique_id"), F.get("embedding", F.lit(0)).cast("double").alias("s"), F.get("embedding", F.lit(1)).cast("double").alias("e"))
    return A.with_results(features, results).select("example", "feature", "unique_id", F.round(F.col("s") + F.col("e"), 8).alias("null_score"))
