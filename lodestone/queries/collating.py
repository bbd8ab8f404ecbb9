"""Word pieces, masks, example builders and feature batches, on documents, benchmark passages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import collating as C
from ..functions import smiles as SM
from ..functions import tokens as K
from ..functions import vectors as V
from ..functions.text import whitespace_tokens
from ..operators import decoding as D
from ..operators.masking import whole_words
from ..operators.subwords import word_pieces
from ..operators.vocabulary import vocabulary
from ._registry import query, read, spread
from .tokens import IDS, L, M, _drawn, flat, h_sql, ids, logits

VOCAB = r"""b AS (SELECT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[^ \t-\r]+')) AS token FROM benchmark) GROUP BY 1 HAVING count(*) >= 3),
v AS (SELECT token FROM b UNION SELECT '##' || right(token, 3) FROM b WHERE length(token) > 3 UNION SELECT chr((97 + i)::INT) FROM range(26) r(i) UNION SELECT '##' || chr((97 + i)::INT) FROM range(26) r(i))"""


@query(
    "text_word_pieces",
    rf"""WITH RECURSIVE {VOCAB}, w AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '[^ \t-\r]+')) AS word FROM documents) GROUP BY 1),
s AS (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM w WHERE length(word) <= 100), e AS (SELECT word, pos, unnest(range(1, least(length(word) - pos + 1, (SELECT max(length(token)) FROM v)) + 1)) AS size FROM s),
m AS (SELECT word, pos, max(size) AS size FROM e WHERE CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(word, pos, size) IN (SELECT token FROM v) GROUP BY 1, 2),
r AS (SELECT word, 1::BIGINT AS pos, ''::VARCHAR AS out FROM w UNION ALL SELECT r.word, r.pos + m.size, out || CASE WHEN r.pos > 1 THEN ' ##' ELSE '' END || substr(r.word, r.pos::INT, m.size::INT) FROM r JOIN m ON m.word = r.word AND m.pos = r.pos),
d AS (SELECT word, out FROM r WHERE pos = length(word) + 1) SELECT word, cnt, coalesce(out, '[UNK]') AS pieces FROM w LEFT JOIN d USING (word)""",
)
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(whitespace_tokens(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    b = read(spark, sf_dir, "benchmark").select(F.explode(whitespace_tokens(F.lower("text"))).alias("token")).groupBy("token").count().where("count >= 3").select("token")
    letters = spark.range(26).select(F.chr(97 + F.col("id")).alias("token"))
    mark = lambda rows, c: rows.select(F.concat(F.lit("##"), c).alias("token"))
    vocab = b.union(mark(b.where(F.char_length("token") > 3), F.right("token", F.lit(3)))).union(letters).union(mark(letters, F.col("token"))).distinct()
    return words.join(word_pieces(words, vocab), "word").select("word", "cnt", F.array_join("pieces", " ").alias("pieces"))


# Blocks of 126 words of whole texts between the marks; every third length continues a word.
BLOCKS = f"{IDS}, k AS (SELECT doc_id, unnest(range(0, greatest(len(ids), 1)::BIGINT, 126)) AS start, ids FROM t WHERE ids IS NOT NULL), b AS (SELECT (doc_id * 512 + start // 126)::BIGINT AS block, [101] || ids[start + 1 : start + 126] || [102] AS ids FROM k)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids(spark, sf_dir).select("doc_id", F.inline(K.spans(F.col("ids"), 126, 126)))
    block = (F.col("doc_id") * 512 + F.floor(F.col("start") / 126)).cast("bigint")
    return rows.select(block.alias("block"), F.concat(F.array(F.lit(101)), "tokens", F.array(F.lit(102))).alias("ids"))


@query(
    "tokens_whole_words_masked",
    f"""WITH RECURSIVE {BLOCKS}, e AS (SELECT block, len(ids) AS n, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM b), u AS (SELECT *, sum(CASE WHEN x % 3 <> 0 OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY i) AS w FROM e WHERE i > 0 AND i < n - 1),
g AS (SELECT block, w, any_value(n) AS n, min(i) AS first, count(*) AS size FROM u GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY {h_sql(f"(block * 4096 + first) % {1 << 31}")}, first) AS k, greatest(1, least(512, round_even(n * 0.15::DOUBLE, 0)))::BIGINT AS budget FROM g),
r AS (SELECT block, 0::BIGINT AS k, 0::BIGINT AS used, -1::BIGINT AS taken FROM b UNION ALL SELECT o.block, o.k, CASE WHEN used + size > budget THEN used ELSE used + size END, CASE WHEN used + size > budget THEN -1 ELSE w::BIGINT END FROM r JOIN o ON o.block = r.block AND o.k = r.k + 1),
c AS (SELECT block, taken FROM r WHERE taken >= 0) SELECT u.block, array_to_string(list(i ORDER BY i), ',') AS masked FROM u JOIN c ON c.block = u.block AND c.taken = u.w GROUP BY 1""",
)
def whole_words_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("ids")
    tokens = F.transform("ids", lambda x, i: F.when(i == 0, "[CLS]").when(i == n - 1, "[SEP]").when(x % 3 == 0, F.concat(F.lit("##"), x.cast("string"))).otherwise(x.cast("string")))
    found = whole_words(_blocks(spark, sf_dir).select("block", tokens.alias("tokens")), "block", "tokens")
    return found.groupBy("block").agg(F.array_sort(F.collect_list("pos")).alias("at")).select("block", flat(F.col("at")).alias("masked"))


@query(
    "tokens_order_collated",
    f"""WITH {BLOCKS}, p AS (SELECT block AS doc_id, ids || list_transform(range(128 - len(ids)), lambda i: 0) AS ids FROM b), e AS (SELECT doc_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM p),
d AS (SELECT doc_id, i, x, {_drawn(1)} < 0.15 AND x NOT IN (0, 101, 102) AS chosen, {_drawn(2)} AS how, floor({_drawn(3)} * 100)::INT AS other FROM e)
SELECT doc_id AS block, sum((chosen)::INT)::BIGINT AS n_masked, sum((1 - chosen::INT))::BIGINT AS attention, sum(i * CASE WHEN chosen AND how < 0.8 THEN 103 WHEN chosen AND how < 0.9 THEN other ELSE x END)::BIGINT AS weighed, sum(CASE WHEN chosen THEN x ELSE -100 END)::BIGINT AS labels FROM d GROUP BY 1""",
)
def order_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).select("block", V.pad(F.col("ids"), 128, 0).alias("ids"))
    new, labels, attention = C.order_collated(F.col("ids"), F.col("block"), 103, 100, [101, 102])
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = rows.select("block", new.alias("new"), labels.alias("labels"), attention.alias("attention"))
    return rows.select("block", total(F.transform("labels", lambda x: (x != -100).cast("int"))).alias("n_masked"), total("attention").alias("attention"), total(F.transform("new", lambda x, i: x * i)).alias("weighed"), total("labels").alias("labels"))


# Sentences are the lines of a document, of so many words; the target is 60 tokens, for one document in ten less.
SENTENCES = r"""s AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')), lambda l: len(regexp_extract_all(l, '[^ \t-\r]+'))) AS sizes FROM documents WHERE text IS NOT NULL)"""
TARGET = f"(CASE WHEN {h_sql('doc_id', 9)} / {float(M)}::DOUBLE < 0.1 THEN 2 + floor({h_sql('doc_id', 8)} / {float(M)}::DOUBLE * 58)::INT ELSE 60 END)"


def _coin(what: int) -> str:
    return f"{h_sql(f'(doc_id * 4096 + first) % {1 << 31}', what)} / {float(M)}::DOUBLE"


def _chunks_sql(put_back: bool) -> str:
    """Recursion from each chunk's first sentence to the next one's."""
    random = f"(past - first = 1 OR {_coin(2)} < 0.5)" if put_back else "false"
    past = "coalesce(list_min(list_filter(range(go + 1, n + 1), lambda e: sums[e + 1] - sums[go + 1] >= target)), n)"
    return f"""{SENTENCES}, z AS (SELECT doc_id, list_transform(range(0, len(sizes)::BIGINT + 1), lambda k: coalesce(list_sum(sizes[1:k]), 0)::BIGINT) AS sums, len(sizes) AS n, {TARGET} AS target FROM s WHERE len(sizes) > 0),
r AS (SELECT doc_id, sums, n, target, 0::BIGINT AS first, 0::BIGINT AS past, 0::BIGINT AS split, false AS random, 0::BIGINT AS go FROM z UNION ALL
SELECT doc_id, sums, n, target, first, past, split, random, CASE WHEN random THEN split ELSE past END AS go FROM (SELECT *, {random} AS random FROM (SELECT *, CASE WHEN past - first > 1 THEN first + 1 + floor({_coin(1)} * (past - first - 1))::BIGINT ELSE past END AS split
FROM (SELECT doc_id, sums, n, target, go AS first, {past} AS past FROM r WHERE go < n)))), c AS (SELECT * FROM r WHERE past > 0)"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.transform(lines, lambda line: F.size(whitespace_tokens(line))).alias("sizes")).where(F.size("sizes") > 0)
    short = K.chance(F.col("doc_id"), 9) < 0.1
    target = F.when(short, 2 + F.floor(K.chance(F.col("doc_id"), 8) * 58).cast("int")).otherwise(60)
    return rows.select("doc_id", C.running_sums(F.col("sizes")).alias("sums"), target.alias("target"))


@query(
    "examples_of_sentence_order",
    f"""WITH RECURSIVE {_chunks_sql(False)}, x AS (SELECT doc_id, first, past, split, sums[split + 1] - sums[first + 1] AS a, sums[past + 1] - sums[split + 1] AS b, {_coin(5)} < 0.5 AS swapped FROM c WHERE past - first > 1),
y AS (SELECT *, CASE WHEN swapped THEN b ELSE a END AS n, CASE WHEN swapped THEN a ELSE b END AS m FROM x), o AS (SELECT *, greatest(0, n + m - 60) AS over FROM y), g AS (SELECT *, least(over, abs(n - m)) AS gap FROM o),
k AS (SELECT *, doc_id * 1000 + first AS kk, (CASE WHEN n > m THEN gap ELSE 0 END + (over - gap) // 2)::BIGINT AS ca, (CASE WHEN m > n THEN gap ELSE 0 END + (over - gap + 1) // 2)::BIGINT AS cb FROM g)
SELECT doc_id, first::INT AS first, past::INT AS past, split::INT AS split, swapped::INT AS label, (n - ca)::INT AS n_a, (m - cb)::INT AS n_b,
len(list_filter(range(1, ca + 1), lambda i: {h_sql(f"(kk * 4096 + i) % {1 << 31}", 3)} / {float(M)}::DOUBLE < 0.5))::INT AS front_a, len(list_filter(range(1, cb + 1), lambda i: {h_sql(f"(kk * 4096 + i) % {1 << 31}", 4)} / {float(M)}::DOUBLE < 0.5))::INT AS front_b FROM k""",
)
def sentence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of a chunk, swapped for half of them (label 1), cut to 60 tokens at random ends."""
    rows = _sentences(spark, sf_dir).select("doc_id", "sums", F.inline(C.chunks(F.col("sums"), F.col("target"), F.col("doc_id")))).where("past - first > 1")
    size = lambda a, b: F.get("sums", F.col(b)) - F.get("sums", F.col(a))
    swapped = K.chance(F.pmod(F.col("doc_id") * 4096 + F.col("first"), F.lit(1 << 31)), 5) < 0.5
    rows = rows.withColumn("a", size("first", "split")).withColumn("b", size("split", "past")).withColumn("swapped", swapped)
    rows = rows.withColumn("n", F.when(F.col("swapped"), F.col("b")).otherwise(F.col("a"))).withColumn("m", F.when(F.col("swapped"), F.col("a")).otherwise(F.col("b")))
    rows = rows.withColumn("cut", C.truncated_at_random(F.col("n"), F.col("m"), 60, F.col("doc_id") * 1000 + F.col("first")))
    left = lambda n, x: (F.col(n) - F.col(f"cut.front_{x}") - F.col(f"cut.back_{x}")).alias(f"n_{x}")
    return rows.select("doc_id", "first", "past", "split", F.col("swapped").cast("int").alias("label"), left("n", "a"), left("m", "b"), "cut.front_a", "cut.front_b")


@query(
    "examples_of_next_sentence",
    f"""WITH RECURSIVE {_chunks_sql(True)}, d AS (SELECT doc_id AS id2, sums AS sums2, n AS n2, row_number() OVER (ORDER BY doc_id) - 1 AS nth, count(*) OVER () AS total FROM z), o AS (SELECT doc_id, nth AS own, total FROM z JOIN d ON id2 = doc_id),
x AS (SELECT c.*, sums[split + 1] - sums[first + 1] AS n_a, (own + 1 + floor({_coin(6)} * (total - 1))::BIGINT) % total AS other, {_coin(7)} AS u FROM c JOIN o USING (doc_id)),
y AS (SELECT x.*, id2, sums2, n2, floor(u * n2)::BIGINT AS start FROM x JOIN d ON d.nth = x.other),
f AS (SELECT *, greatest(target - n_a, 0) AS room FROM y)
SELECT doc_id, first::INT AS first, past::INT AS past, split::INT AS split, random::INT AS label, n_a::INT AS n_a, CASE WHEN random THEN id2 ELSE doc_id END AS source, (CASE WHEN random THEN start ELSE split END)::INT AS start,
(CASE WHEN random THEN sums2[coalesce(list_min(list_filter(range(start + 1, n2 + 1), lambda e: sums2[e + 1] - sums2[start + 1] >= room)), n2) + 1] - sums2[start + 1] ELSE sums[past + 1] - sums[split + 1] END)::INT AS n_b FROM f""",
)
def next_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second part is the rest of the chunk, or for half of them (and for single sentences) sentences of another
    document, from a random one until the target is reached; those not used go to the next chunk."""
    from ..operators.sequences import numbered

    placed = numbered(_sentences(spark, sf_dir), ["doc_id"])
    total = placed.count()
    rows = placed.select("doc_id", "nth", "sums", "target", F.inline(C.chunks(F.col("sums"), F.col("target"), F.col("doc_id"), put_back=0.5)))
    coin = lambda what: K.chance(F.pmod(F.col("doc_id") * 4096 + F.col("first"), F.lit(1 << 31)), what)
    rows = rows.withColumn("other", F.pmod(F.col("nth") + 1 + F.floor(coin(6) * (total - 1)), F.lit(total)))
    rows = rows.join(placed.select(F.col("nth").alias("other"), F.col("doc_id").alias("id2"), F.col("sums").alias("sums2")), "other")
    size = lambda c, a, b: F.get(c, b) - F.get(c, a)
    n2 = F.size("sums2") - 1
    rows = rows.withColumn("n_a", size("sums", F.col("first"), F.col("split"))).withColumn("start", F.floor(coin(7) * n2).cast("int"))
    room = F.greatest(F.col("target") - F.col("n_a"), F.lit(0))
    ends = F.filter(F.sequence(F.col("start") + 1, n2), lambda e: size("sums2", F.col("start"), e) >= room)
    n_b = F.when(F.col("random"), size("sums2", F.col("start"), F.coalesce(F.get(ends, F.lit(0)), n2))).otherwise(size("sums", F.col("split"), F.col("past")))
    pick = lambda a, b: F.when(F.col("random"), F.col(a)).otherwise(F.col(b))
    return rows.select("doc_id", "first", "past", "split", F.col("random").cast("int").alias("label"), "n_a", pick("id2", "doc_id").alias("source"), pick("start", "split").alias("start"), n_b.alias("n_b"))


PAIR = f"{IDS}, p AS (SELECT doc_id, ids AS a, ids[3 : doc_id % 50 + 2] AS b FROM t), q AS (SELECT doc_id, a, b, len(a) AS n, len(b) AS m, greatest(0, len(a) + len(b) - 61) AS over FROM p), g AS (SELECT *, least(over, abs(n - m)) AS gap FROM q), c AS (SELECT doc_id, a[1:n - (CASE WHEN n > m THEN gap ELSE 0 END + (over - gap) // 2)] AS a, b[1:m - (CASE WHEN m > n THEN gap ELSE 0 END + (over - gap + 1) // 2)] AS b FROM g)"


@query(
    "glue_features",
    f"""WITH {PAIR}, f AS (SELECT doc_id, [101] || a || [102] || b || [102] AS ids, len(a) + 2 AS first, len(b) + 1 AS second FROM c)
SELECT f.doc_id, array_to_string(ids || list_transform(range(64 - len(ids)), lambda i: 0), ',') AS input_ids, len(ids)::BIGINT AS attended, second::BIGINT AS second_segment, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 WHEN 'fr' THEN 2 END::INT AS label, CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 0 WHEN 'fr' THEN 1 END::INT AS swapped, n_chars::DOUBLE AS score FROM f JOIN documents USING (doc_id)""",
)
def glue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as features of 64 tokens, a class by its place in the list of labels (two of them swapped for some models), and a regression target."""
    rows = ids(spark, sf_dir).select("doc_id", C.pair_features(F.col("ids"), F.slice("ids", F.lit(3), (F.col("doc_id") % 50).cast("int")), 64, 101, 102).alias("f"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = ["de", "en", "fr"]
    total = lambda c: V.total(V.doubles(F.col(c))).cast("bigint")
    return rows.join(docs, "doc_id").select("doc_id", flat(F.col("f.input_ids")).alias("input_ids"), total("f.attention_mask").alias("attended"), total("f.token_type_ids").alias("second_segment"), C.label_id(F.col("lang"), labels).alias("label"), C.label_id(F.col("lang"), labels, (1, 2)).alias("swapped"), F.col("n_chars").cast("double").alias("score"))


@query(
    "classification_features",
    r"""WITH t AS (SELECT item_id, list_transform(regexp_extract_all(text, '[^ \t-\r]+'), lambda w: least(length(w), 99)) AS ids FROM benchmark), w AS (SELECT max(len(ids)) + 2 AS width FROM t), f AS (SELECT item_id, [101] || ids || [102] AS ids, width FROM t, w)
SELECT item_id, array_to_string(list_transform(range(width - len(ids)), lambda i: 0) || ids, ',') AS input_ids, (width - len(ids))::BIGINT AS masked, (item_id % 2)::INT AS label FROM f""",
)
def classification_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded on the left to the longest of all, with a mask that is 1 on padding."""
    words = F.transform(whitespace_tokens(F.col("text")), lambda w: F.least(F.char_length(w), F.lit(99)))
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.array(F.lit(101)), words, F.array(F.lit(102))).alias("ids"))
    width = rows.agg(F.max(F.size("ids")).alias("width"))  # one row
    p = C.padded(F.col("ids"), F.col("width"), left=True)
    rows = rows.crossJoin(F.broadcast(width)).select("item_id", p.alias("p"))
    return rows.select("item_id", flat(F.col("p.input_ids")).alias("input_ids"), V.total(V.doubles(F.transform("p.attention_mask", lambda x: 1 - x))).cast("bigint").alias("masked"), (F.col("item_id") % 2).cast("int").alias("label"))


@query(
    "seq2seq_batch",
    f"""WITH {IDS}, b AS (SELECT doc_id, ids[1:31] || [2] AS a, list_reverse(ids)[1:15] || [2] AS b FROM t) SELECT doc_id, array_to_string(a || list_transform(range(32 - len(a)), lambda i: 0), ',') AS input_ids, len(a)::BIGINT AS attended, array_to_string(b || list_transform(range(16 - len(b)), lambda i: 0), ',') AS labels FROM b""",
)
def seq2seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources cut to 32 tokens and targets to 16, the lengths of the model."""
    rows = ids(spark, sf_dir).select("doc_id", C.seq2seq(F.col("ids"), F.reverse("ids"), 32, 16, 2).alias("f"))
    return rows.select("doc_id", flat(F.col("f.input_ids")).alias("input_ids"), V.total(V.doubles(F.col("f.attention_mask"))).cast("bigint").alias("attended"), flat(F.col("f.labels")).alias("labels"))


@query(
    "text_added_tokens",
    r"""WITH m AS (SELECT item_id, string_split(regexp_replace(text, '(the|an|a|[.])', chr(2) || '\1' || chr(2), 'g'), chr(2)) AS p FROM benchmark), f AS (SELECT item_id, list_filter(p, lambda x: x <> '') AS p FROM m)
SELECT item_id, len(p)::INT AS n, len(list_filter(p, lambda x: x IN ('the', 'an', 'a', '.')))::INT AS n_added, array_to_string(p, '|') AS parts FROM f""",
)
def added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", C.split_on_added(F.col("text"), ["a", ".", "the", "an"]).alias("p"))
    return rows.select("item_id", F.size("p").alias("n"), F.size(F.filter("p", lambda x: x.isin("the", "an", "a", "."))).alias("n_added"), F.array_join("p", "|").alias("parts"))


@query(
    "tokens_trimmed_batches",
    f"""WITH {IDS}, p AS (SELECT doc_id, piece::INT AS piece, doc_id // 8 AS batch, [101] || ids[60 * piece + 1:60 * piece + 60] || [102] AS ids FROM t, range(0, greatest(1, (len(ids) + 59) // 60)) r(piece)), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch, piece) AS width FROM p)
SELECT doc_id, piece, array_to_string((ids || list_transform(range(64 - len(ids)), lambda i: 0))[1:width], ',') AS input_ids, width::INT AS width, len(list_filter((ids || list_transform(range(64 - len(ids)), lambda i: 0))[1:width], lambda x: x IN (0, 101, 102)))::BIGINT AS n_special FROM w""",
)
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of 60 tokens, padded to 64, cut to the last attended place of their batch of eight."""
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("ids") - 1) / 60).cast("int"))))
    rows = ids(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), "ids", pieces.alias("piece"))
    rows = rows.withColumn("ids", F.concat(F.array(F.lit(101)), F.slice("ids", 60 * F.col("piece") + 1, F.lit(60)), F.array(F.lit(102))))
    rows = rows.select("doc_id", "piece", "batch", C.padded(F.col("ids"), F.lit(64)).alias("p"))
    last = F.array_max(F.transform("p.attention_mask", lambda x, i: x * (i + 1)))
    rows = rows.withColumn("width", F.max(last).over(Window.partitionBy("batch", "piece"))).withColumn("cut", F.slice("p.input_ids", F.lit(1), F.col("width")))
    return rows.select("doc_id", "piece", flat(F.col("cut")).alias("input_ids"), "width", V.total(V.doubles(C.special_mask(F.col("cut"), [0, 101, 102]))).cast("bigint").alias("n_special"))


@query(
    "tokens_decoded",
    r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[^ \t-\r]+') AS w FROM benchmark), e AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM w),
v AS (SELECT token FROM e GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, token) <= 100) SELECT item_id, string_agg(v.token, ' ' ORDER BY pos) FILTER (v.token IS NOT NULL) AS text, count(*) FILTER (v.token IS NULL) AS n_skipped FROM e LEFT JOIN v USING (token) GROUP BY 1""",
)
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids back to text, the unknown token skipped."""
    from ..operators.vocabulary import decoded as decode
    from ..operators.vocabulary import encoded

    rows = read(spark, sf_dir, "benchmark").select("item_id", whitespace_tokens(F.lower("text")).alias("tokens"))
    vocab = vocabulary(rows, "tokens", ["<unk>"], 100)
    found = encoded(rows, "item_id", "tokens", vocab, 0)
    return decode(found, "item_id", "ids", vocab, [0]).select("item_id", F.when(F.col("text") != "", F.col("text")).alias("text"), "n_skipped")


@query(
    "decode_bad_words",
    f"""WITH {L}, g AS (SELECT vec_id, [(vec_id * 7) % 16, (vec_id * 5) % 8] AS g FROM embeddings), d AS (SELECT vec_id, 9 AS token FROM g UNION SELECT vec_id, 20 FROM g WHERE g[2] = 3 UNION SELECT vec_id, 30 FROM g WHERE g[1] = 4 AND g[2] = 4 UNION SELECT vec_id, 31 FROM g WHERE false)
SELECT vec_id, token::INT AS token, round(logit / 0.7, 6) AS logit FROM l ANTI JOIN d USING (vec_id, token)""",
)
def bad_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bans of one word of one token, of two and three, of one longer than the sequence, and of none for the end."""
    rows = logits(spark, sf_dir)
    sequences = read(spark, sf_dir, "embeddings").select("vec_id", F.array((F.col("vec_id") * 7 % 16).cast("int"), (F.col("vec_id") * 5 % 8).cast("int")).alias("tokens"))
    bans = D.bad_words(sequences, [[9], [3, 20], [4, 4, 30], [1, 2, 3, 31], [5]], "vec_id", 5)
    out = D.chained(rows, lambda r: D.banned(r, bans, "vec_id"), lambda r: D.temperature(r, 0.7))
    return out.where("logit > double('-Infinity')").select("vec_id", "token", F.round("logit", 6).alias("logit"))


@query(
    "decode_top_k_top_p",
    f"""WITH {L}, k AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 12), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM k),
b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT vec_id, token::INT AS token FROM b WHERE before <= 0.7""",
)
def top_k_top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_k_top_p(logits(spark, sf_dir), "vec_id", 12, 0.7).where("logit > double('-Infinity')").select("vec_id", "token")


# The error function by its series, or its asymptotic one where the argument is over 4.
@query(
    "activation_gelu",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE * 3 AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), z AS (SELECT *, abs(x) / sqrt(2::DOUBLE) AS z FROM x),
s AS (SELECT vec_id, pos, sum(exp(n * ln(4::DOUBLE) + lgamma(n + 1) - lgamma(2 * n + 2) + (2 * n + 1) * ln(z) - z * z)) * 2 / sqrt(pi()) AS erf FROM z, range(100) r(n) WHERE z > 0 AND z <= 4 GROUP BY 1, 2)
SELECT vec_id, pos::INT AS pos, round(0.5 * x * (1 + sign(x) * CASE WHEN z = 0 THEN 0 WHEN z <= 4 THEN erf ELSE 1 - exp(-z * z) / (z * sqrt(pi())) * (1 - 1 / (2 * z * z) + 3 / (4 * z ** 4)) END), 8) AS gelu FROM z LEFT JOIN s USING (vec_id, pos)""",
)
def gelu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round(V.ACTIVATIONS["gelu"](F.col("x").cast("double") * 3), 8).alias("gelu"))


SMILES = """m AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'CC(=O)NC1=CC=C(O)C=C1' WHEN 1 THEN 'ClC1=CC=C(Br)C=C1' WHEN 2 THEN 'C[Si](C)(C)C#N' WHEN 3 THEN '[Na+].[Cl-]' WHEN 4 THEN 'C[C@@H](N)C(=O)O' WHEN 5 THEN 'C[Se]C' ELSE 'c1ccccc1' END || repeat('C', p_size % 30) AS smiles FROM part)"""


def _smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    head = F.when(k == 0, "CC(=O)NC1=CC=C(O)C=C1").when(k == 1, "ClC1=CC=C(Br)C=C1").when(k == 2, "C[Si](C)(C)C#N").when(k == 3, "[Na+].[Cl-]").when(k == 4, "C[C@@H](N)C(=O)O").when(k == 5, "C[Se]C").otherwise("c1ccccc1")
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.concat(head, F.repeat(F.lit("C"), (F.col("p_size") % 30).cast("int"))).alias("smiles"))


_LETTERS = "replace(replace(replace(replace(replace(replace(smiles, 'Br', 'R'), 'Cl', 'L'), 'Si', 'X'), 'Se', 'E'), 'se', 'e'), '@@', '&')"
_TOKENS = "[" + ", ".join(f"'{t}'" for t in SM.TOKENS) + "]"


@query(
    "smiles_legal_ids",
    f"""WITH {SMILES}, e AS (SELECT p_partkey, smiles, string_split({_LETTERS}, '') AS t FROM m), i AS (SELECT *, [1] || list_transform(t, lambda c: list_position({_TOKENS}, c) - 1) || [2] AS ids FROM e),
v AS (SELECT *, NOT contains(smiles, 'Na') AND len(ids) <= 40 AND len(list_filter(ids, lambda x: x IS NULL)) = 0 AS valid FROM i)
SELECT p_partkey, array_to_string(CASE WHEN valid THEN ids || list_transform(range(40 - len(ids)), lambda i: 0) ELSE list_transform(range(40), lambda i: 0) END, ',') AS ids, valid, CASE WHEN valid THEN smiles ELSE '' END AS text FROM v""",
)
def smiles_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of legal, short texts whose characters all have one, and the text from the ids again."""
    rows = _smiles(spark, sf_dir).select("p_partkey", SM.legal_ids(F.col("smiles"), 40, ["Na"]).alias("f"))
    return rows.select("p_partkey", flat(F.col("f.ids")).alias("ids"), "f.valid", SM.from_ids(F.col("f.ids"), trim=True).alias("text"))


@query("smiles_marked_text", f"WITH {SMILES} SELECT p_partkey, '[CLS]' || smiles || '[SEP]' || repeat('[PAD]', 60 - 2 - length({_LETTERS})) AS text FROM m WHERE p_partkey % 7 NOT IN (3, 6) AND length({_LETTERS}) <= 58")
def marked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _smiles(spark, sf_dir).select("p_partkey", SM.legal_ids(F.col("smiles"), 60, ["Na"]).alias("f")).where("f.valid")
    return rows.select("p_partkey", SM.from_ids(F.col("f.ids")).alias("text"))
