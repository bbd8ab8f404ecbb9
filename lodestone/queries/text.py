"""Text normalisation, tokenising and answers, on documents, pages, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as X
from ._registry import query, read

WS = r"[ \t-\r]"
NOT_WS = r"[^ \t-\r]"


def norm_sql(s: str) -> str:
    return rf"array_to_string(list_filter(regexp_extract_all(regexp_replace(lower({s}), '[!-/:-@\[-`{{-~]', '', 'g'), '{NOT_WS}+'), lambda w: w NOT IN ('a', 'an', 'the')), ' ')"


def _simple(name: str, sql: str, f, table: str = "documents", key: str = "doc_id", column: str = "text"):
    @query(name, f"SELECT {key}, md5({sql.format(s=column)}) AS digest FROM {table}")
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).select(key, F.md5(f(F.col(column)).cast("binary")).alias("digest"))


_simple("text_normalize_answer", norm_sql("{s}").replace("{-~", "{{-~"), X.normalize_answer)
_simple("text_clean_up_tokenization", "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({s}, ' .', '.'), ' ?', '?'), ' !', '!'), ' ,', ','), ' '' ', ''''), ' n''t', 'n''t'), ' ''m', '''m'), ' ''s', '''s'), ' ''ve', '''ve'), ' ''re', '''re')", X.clean_up_tokenization)
_simple("text_tokenize_numbers", r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({s}, '(\d),(\d)', '\1 @,@ \2', 'g'), '(\d),(\d)', '\1 @,@ \2', 'g'), '(\d)\.(\d)', '\1 @.@ \2', 'g'), '(\d)\.(\d)', '\1 @.@ \2', 'g')", X.tokenize_numbers)
_simple("text_number_round_trip", "replace(replace({s}, ' @,@ ', ','), ' @.@ ', '.')", lambda s: X.detokenize_numbers(X.tokenize_numbers(s)))
def _entities_sql() -> str:
    """Each named entity replaced in turn, & last, so that nothing is decoded twice."""
    out, quoted = "{s}", lambda t: "'" + t.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"
    for old, new in sorted(X.ENTITIES.items(), key=lambda pair: pair[0] == "&amp;"):
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    return out


_simple("text_html_entities", _entities_sql(), X.html_entities, "pages", "page_id", "html")
_simple("text_narrow_punctuation", "translate(regexp_replace({s}, '。[ \\t-\\r]*', '. ', 'g'), '" + X.WIDE.replace("'", "''") + "', '" + X.NARROW.replace("'", "''") + "')", X.narrow_punctuation)
_simple("text_drop_control", r"regexp_replace({s}, '[\x00-\x1f\x7f-\x9f]', '', 'g')", X.drop_control)
_simple(
    "text_standardize",
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace({s}, '—', '-'), '–', '-'), '―', '-'), '…', '...'), '´', ''''),
'(-+|~+|!+|"+|;+|\?+|\++|,+|\)+|\(+|\\+|/+|\*+|\[+|\]+|\}}+|\{{+|\|+|_+)', ' \1 ', 'g'), '[ \t\r\f\x0b]*\n[ \t\r\f\x0b]*', chr(32) || chr(10) || chr(32), 'g'), '[ \t\r\f\x0b]+', ' ', 'g'), '^[ \t-\r]+|[ \t-\r]+$', '', 'g')""",
    X.text_standardize,
)


@query("text_whitespace_tokens", f"SELECT doc_id, len(t)::INT AS n, t[1] AS first, t[-1] AS last FROM (SELECT doc_id, regexp_extract_all(text, '{NOT_WS}+') AS t FROM documents)")
def whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents").select("doc_id", X.whitespace_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"))


@query("text_basic_tokens", rf"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[!-/:-@\[-`{{-~\pP]|[^ \t-\r\p{{Zs}}!-/:-@\[-`{{-~\pP]+') AS t FROM documents)")
def basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents").select("doc_id", X.basic_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("text_character_classes", r"SELECT doc_id, len(regexp_extract_all(text, '[ \t-\r]'))::INT AS n_space, len(regexp_extract_all(text, '[!-/:-@\[-`{-~]'))::INT AS n_punctuation, len(regexp_extract_all(text, '[0-9]'))::INT AS n_digit FROM documents")
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p, name: F.regexp_count("text", F.lit(p)).alias(name)
    return read(spark, sf_dir, "documents").select("doc_id", n(r"[ \t-\r]", "n_space"), n(r"[!-/:-@\[-`{-~]", "n_punctuation"), n("[0-9]", "n_digit"))


@query("text_legal", "SELECT p_partkey, NOT (contains(p_name, 'ee') OR contains(p_type, 'BRASS')) AS legal, len(p_name) <= 20 AS short FROM part")
def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", (X.is_legal(F.col("p_name"), ["ee"]) & X.is_legal(F.col("p_type"), ["BRASS"])).alias("legal"), (F.char_length("p_name") <= 20).alias("short"))


@query(
    "text_vocabulary",
    f"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '{NOT_WS}+')) AS token FROM documents),
c AS (SELECT token, count(*) AS cnt FROM t GROUP BY 1 HAVING count(*) >= 5) SELECT token, cnt, 3 + row_number() OVER (ORDER BY cnt DESC, token) AS id FROM c QUALIFY id <= 2003""",
)
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vocabulary import vocabulary as build

    return build(read(spark, sf_dir, "documents").select(X.whitespace_tokens(F.lower("text")).alias("tokens")), "tokens", specials=["<unk>", "<pad>", "<eos>", "<bos>"], max_size=2000, min_freq=5).where("cnt is not null").select("token", "cnt", F.col("id").cast("bigint").alias("id"))


@query(
    "squad_exact_f1",
    rf"""WITH p AS (SELECT a.item_id, a.text AS gold, b.text || ' ' || a.text AS pred FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
n AS (SELECT item_id, {norm_sql("gold")} AS g, {norm_sql("pred")} AS p FROM p), t AS (SELECT item_id, g, p, regexp_extract_all(g, '{NOT_WS}+') AS gt, regexp_extract_all(p, '{NOT_WS}+') AS pt FROM n),
o AS (SELECT item_id, sum(least(a, b))::DOUBLE AS same FROM (SELECT item_id, tok, count(*) AS a FROM (SELECT item_id, unnest(gt) AS tok FROM t) GROUP BY 1, 2) x JOIN (SELECT item_id, tok, count(*) AS b FROM (SELECT item_id, unnest(pt) AS tok FROM t) GROUP BY 1, 2) y USING (item_id, tok) GROUP BY 1)
SELECT t.item_id, (g = p)::INT AS exact, round(CASE WHEN len(gt) = 0 OR len(pt) = 0 THEN (len(gt) = len(pt))::INT ELSE 2 * coalesce(same, 0) / (len(gt) + len(pt)) END, 9) AS f1 FROM t LEFT JOIN o USING (item_id)""",
)
def squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    rows = b.join(other, "item_id").select("item_id", F.col("text").alias("gold"), F.concat("other", F.lit(" "), "text").alias("pred"))
    return rows.select("item_id", X.exact_match(F.col("pred"), F.col("gold")).alias("exact"), F.round(X.token_f1(F.col("pred"), F.col("gold")), 9).alias("f1"))


@query("rag_context", """SELECT a.item_id, md5(replace('context: ' || regexp_replace(a.text, '^"|"$', '', 'g') || ' / ' || b.text || ' // ' || a.text, '  ', ' ')) AS digest FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", F.md5(X.context_string(F.col("text"), F.col("other"), F.col("text"), "context: ").cast("binary")).alias("digest"))


@query("conversation_history", "SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS responses, md5(string_agg(text, chr(10) ORDER BY turn)) AS history FROM conversations GROUP BY 1")
def conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("responses"), F.md5(F.array_join(ordered, "\n").cast("binary")).alias("history"))


@query(
    "entity_groups",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM c)
SELECT user_id, min(i)::INT AS start, event_type AS entity, count(*) AS n, round(avg(value), 8) AS score FROM g GROUP BY user_id, grp, event_type""",
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sequences import runs

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("i", F.row_number().over(order))
    grouped = runs(rows, ["user_id"], "i", "event_type")
    return grouped.groupBy("user_id", "run", F.col("event_type").alias("entity")).agg(F.min("i").alias("start"), F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("score")).drop("run")


_NER = """n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id, event_type, value FROM events),
t AS (SELECT user_id, i + i // 7 AS index, CASE WHEN event_id % 4 = 0 THEN 'B-' ELSE 'I-' END || event_type AS entity, value AS score, CASE WHEN event_id % 5 = 0 THEN '##' ELSE '' END || event_type AS word, event_id % 5 = 0 AS is_subword FROM n)"""


@query(
    "entity_groups_marked",
    f"""WITH {_NER}, a AS (SELECT *, is_subword AND row_number() OVER w > 1 AS sub FROM t WINDOW w AS (PARTITION BY user_id ORDER BY index)),
b AS (SELECT *, last_value(CASE WHEN NOT sub THEN split_part(entity, '-', 2) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS kind FROM a),
c AS (SELECT *, CASE WHEN sub OR coalesce(lag(kind) OVER w = kind AND entity NOT LIKE 'B-%' AND lag(index) OVER w = index - 1, false) THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY index)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS grp FROM c)
SELECT user_id, min(index)::BIGINT AS start, arg_min(kind, index) AS entity, round(avg(score) FILTER (NOT sub), 8) AS score, trim(replace(string_agg(word, ' ' ORDER BY index), ' ##', '')) AS word FROM g GROUP BY user_id, grp""",
)
def entities_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the marks B and I, with subwords and gaps."""
    from ..operators.sequences import entity_groups

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read(spark, sf_dir, "events").withColumn("i", i)
    sub = F.col("event_id") % 5 == 0
    rows = rows.select(
        "user_id", (F.col("i") + F.floor(F.col("i") / 7)).alias("index"), F.concat(F.when(F.col("event_id") % 4 == 0, "B-").otherwise("I-"), "event_type").alias("entity"),
        F.col("value").alias("score"), F.concat(F.when(sub, "##").otherwise(""), "event_type").alias("word"), sub.alias("is_subword"),
    )
    found = entity_groups(rows, ["user_id"])
    return found.select("user_id", F.col("start").cast("bigint").alias("start"), "entity", F.round("score", 8).alias("score"), "word")


@query("zero_shot_pairs", "SELECT p_partkey, p_name AS premise, 'A ' || trim(unnest([p_brand, p_type, 'none'])) || ' thing, {}.' AS hypothesis FROM part")
def zero_shot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name with a hypothesis for each of its labels, which stand in one text."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_brand", F.lit(" ,  "), "p_type", F.lit(",none")).alias("labels"))
    return rows.select("p_partkey", F.col("p_name").alias("premise"), F.explode(X.hypotheses(X.label_list(F.col("labels")), "A {} thing, {{}}.")).alias("hypothesis"))
