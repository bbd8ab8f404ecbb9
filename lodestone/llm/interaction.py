"""How the filters of a corpus act on each other, in every order that they can be applied in.

Filters are applied depth first along the trie of their permutations.  What survives a set of filters
doesn't depend on their order, so the nodes of the trie that stand for one unordered prefix share one
persisted survivor table: each of the 2^k sets is made once, from the survivors of the set that led there
first, and given up when the branch of the root that it is in is done.  Along each edge (survivors of a set, the next filter) the
rows that the filter removes are counted, for each part of the corpus.

A row is a document: its part, what it fails, and whether a label calls it good or toxic.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

WORD = "[^\\x20\\x09-\\x0D]+"
MARKS = "#$%&*|"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
#: Its filter needs the whole table.
REPEATED = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: A too few words, B too few distinct ones, C too many capitals, D marks."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    total, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": total < MIN_WORDS,
        "B": F.lit(100).cast("long") * distinct < F.lit(MIN_DISTINCT_PERCENT) * total,
        "C": F.lit(100).cast("long") * capitals > F.lit(MAX_CAPITAL_PERCENT) * F.char_length(text),
        "D": text.rlike(f"[{MARKS}]"),
    }


def _mask(failures: dict[str, Column], names: list[str]) -> Column:
    bits = [F.when(F.coalesce(f, F.lit(False)), 1 << names.index(n)).otherwise(0) for n, f in failures.items()]
    return sum(bits[1:], bits[0])


def document_failures(docs: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """part, mask (bit i: fails names[i]), good and toxic of each row of docs (doc_id, text, lang); a written table.

    Null texts and languages are empty ones.  A text is repeated if a smaller doc_id has the same one, whatever
    else either fails; rows with a null doc_id neither are repeated nor make others so, rows of one doc_id and
    text are equal in this.  A doc_id that several rows of labels (doc_id, quality, toxic) name is good or toxic
    if one of them says so.  Further columns of either table are ignored.  The text itself is never shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", _mask(text_failures(F.col("text")), names).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = written(rows, "interaction-rows")
    # Only texts of several ids are joined back; large groups of copies are split by the skew join.
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    rows = rows.join(shared, "digest", "left")
    rows = rows.select("doc_id", "part", "mask", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("repeated"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marked, "doc_id", "left")
    bit = F.when(F.col("repeated"), 1 << names.index(REPEATED)).otherwise(0)
    return written(rows.select("part", (F.col("mask") + bit).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), "interaction-failures")


def edge_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """part, state (filters applied, as bits), filter (its bit's number), kept, removed, failing, unique_fails,
    good_lost and toxic_lost, for the parts with rows left in the state.

    failing and unique_fails are those of the part, and stand in state 0 alone.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "interaction-edges")
    seen: set[int] = set()

    def counted(state: int, survivors: DataFrame) -> DataFrame:
        rest = [i for i in range(n_filters) if not state >> i & 1]
        counts, edges = ["count(*) AS rows"], []
        for i in rest:
            fails = f"mask & {1 << i} <> 0"
            counts += [f"count_if({fails}) AS removed{i}", f"count_if({fails} AND good = 1) AS good{i}", f"count_if({fails} AND toxic = 1) AS toxic{i}", f"count_if(mask = {1 << i}) AS unique{i}"]
            edges.append(f"named_struct('filter', {i}, 'kept', rows - removed{i}, 'removed', removed{i}, 'unique_fails', unique{i}, 'good_lost', good{i}, 'toxic_lost', toxic{i})")
        return survivors.groupBy("part").agg(*map(F.expr, counts)).selectExpr("part", f"{state} AS state", f"inline(array({', '.join(edges)}))")

    def apply(state: int, survivors: DataFrame) -> list[tuple[int, DataFrame]]:
        """The states that are first reached below this one, with their persisted survivors."""
        seen.add(state)
        found = [(state, survivors)]
        for i in range(n_filters):
            after = state | 1 << i
            # The last filter's survivors are counted on the edge to it.
            if after not in seen and after != (1 << n_filters) - 1:
                found += apply(after, survivors.where(f"mask & {1 << i} = 0").persist())
        return found

    # A branch of the root at a time: its states depend on no other branch.
    root = rows.persist()
    counted(0, root).write.mode("append").parquet(path)
    for i in range(n_filters):
        if 1 << i in seen or n_filters == 1:
            continue
        branch = apply(1 << i, root.where(f"mask & {1 << i} = 0").persist())
        functools.reduce(DataFrame.unionAll, [counted(*node) for node in branch]).write.mode("append").parquet(path)
        for _, survivors in branch:
            survivors.unpersist()
    root.unpersist()
    return spark.read.schema("part string, state int, filter int, kept long, removed long, unique_fails long, good_lost long, toxic_lost long").parquet(path)


def _orders(spark: SparkSession, names: list[str]) -> DataFrame:
    """filter_order, step, state before it and filter: k * k! rows, whatever the corpus."""
    found = []
    for order in itertools.permutations(range(len(names))):
        state = 0
        for step, i in enumerate(order, 1):
            found.append(("".join(names[j] for j in order), step, state, i))
            state |= 1 << i
    return spark.createDataFrame(found, "filter_order string, step int, state int, filter int")


def filter_interactions(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row per part, order of the filters and step; rows as document_failures gives them.

    Zeros are rows too.  An empty table has no parts, so no rows.
    """
    k, spark = len(names), rows.sparkSession
    edges = edge_counts(rows, k)
    value = "struct(kept, removed, unique_fails, good_lost, toxic_lost)"
    # k * 2^(k-1) entries a part at most; a part that a state leaves no rows of has none there.
    parts = edges.groupBy("part").agg(F.expr(f"map_from_entries(collect_list(struct(state * {k} + filter, {value})))").alias("edges"))

    def at(state: str | int, number: str | int, name: str) -> str:
        return f"coalesce(try_element_at(edges, {state} * {k} + {number}).{name}, 0L)"

    def shapley(i: int) -> str:
        without = [s for s in range(1 << k) if not s >> i & 1]
        return " + ".join(f"{math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())}L * {at(s, i, 'removed')}" for s in without)

    every = ", ".join(f"struct({s} AS state, {i} AS filter)" for s in range(1 << k) for i in range(k) if not s >> i & 1)
    parts = parts.selectExpr("*", f"array({', '.join(map(shapley, range(k)))}) AS shapleys").selectExpr("*", f"inline(array({every}))")
    rows = parts.selectExpr(
        "part", "state", "filter",
        *[f"{at('state', 'filter', name)} AS {name}" for name in ("kept", "removed", "good_lost", "toxic_lost")],
        f"{at(0, 'filter', 'removed')} - {at('state', 'filter', 'removed')} AS redundant",
        f"{at(0, 'filter', 'unique_fails')} AS unique_fails",
        "shapleys[filter] AS shapley",
    )
    rows = rows.join(F.broadcast(_orders(spark, names)), ["state", "filter"])
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters A to E over docs (doc_id, text, lang), by language; see document_failures for odd rows."""
    names = ["A", "B", "C", "D", REPEATED]
    return filter_interactions(document_failures(docs, labels, names), names)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITAL_PERCENT} * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[{MARKS}]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, x,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, contains(fails, x) AS hit, earlier <> '' AND fails <> '' AND regexp_matches(fails, '[' || earlier || '0]') AS gone FROM c, s)
  GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r"""
