"""How far the sources of a language diverge in their words, and by which words.

Terms are counted in shards by a hash of language and term.  Each shard's rows stream into DuckDB, which sums
them in SQL, keeps the terms that enough documents hold, and, once the sums of all shards are known, gives its
shard's part of every pair of sources and its highest terms.  Spark counts documents' terms before the shuffle,
adds the shards' parts and ranks.

All arithmetic is on whole numbers.  A source's share of a term is p = 1 + floor(SCALE * (n + 2) / (N + 2 V)),
two shares differ by f = floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, released, written

SCALE, MIN_DOCS, TOP = 1_000_000_000, 10, 10
#: Rows that a task's table of counts holds before they go on, rows of counts that a shard is dealt, and documents to a batch.
HELD, SHARD_ROWS, BATCH = 200_000, 500_000, 256
#: Bytes of text that are cut into terms at once.
CHUNK = 4 << 20

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _run(db: duckdb.DuckDBPyConnection, sql: str) -> list[tuple]:
    return db.execute(sql).fetchall()


def _rows(db: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from db.sql(sql).to_arrow_reader(10_000)


def _database() -> duckdb.DuckDBPyConnection:
    """One thread, in memory; shards are dealt so that they fit."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, lower-cased, and the text that each is in."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = _TERM[data]
    after = np.zeros(len(data), bool)
    after[1:] = inside[:-1]
    after[ends[:-1][ends[:-1] < len(data)]] = False
    begins = np.flatnonzero(inside & ~after)
    letters = _LOWER[data[inside]]
    offsets = np.append((np.cumsum(inside) - 1)[begins], len(letters)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(letters))
    return terms, np.searchsorted(ends, begins, "right") - 1


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about CHUNK bytes of text together; one text stays whole."""
    size, at, held = batch.column("text").nbytes, 0, 0
    if size <= CHUNK:
        yield batch
        return
    lengths = np.diff(np.frombuffer(batch.column("text").cast(pa.large_string()).buffers()[1], np.int64, batch.num_rows + 1, 0))
    for i, n in enumerate(lengths):
        if held and held + n > CHUNK:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def _drained(db: duckdb.DuckDBPyConnection) -> Iterator[pa.RecordBatch]:
    yield from _rows(db, "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL")
    _run(db, "CREATE OR REPLACE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")


@released
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    db = _database()
    _run(db, "CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    for whole in batches:
        whole = pa.RecordBatch.from_arrays([pa.concat_arrays([whole.column(c).cast(pa.large_string()).fill_null("")]) for c in ("lang", "source", "text")], ["lang", "source", "text"])
        for batch in _pieces(whole):
            terms, owner = _terms(batch.column("text"))
            if not len(terms):
                continue
            codes = terms.dictionary_encode()
            db.register("tokens", pa.table({"row": owner, "code": codes.indices}))
            db.register("names", pa.table({"code": pa.array(np.arange(len(codes.dictionary), dtype=np.int32)), "term": codes.dictionary}))
            db.register("rows", pa.table({"row": np.arange(batch.num_rows), "lang": batch.column("lang"), "source": batch.column("source")}))
            _run(
                db,
                """INSERT INTO held SELECT lang, source, term, n, docs FROM (
                     SELECT lang, source, code, sum(n) AS n, count(*) AS docs
                     FROM (SELECT row, code, count(*) AS n FROM tokens GROUP BY row, code) JOIN rows USING (row) GROUP BY ALL) JOIN names USING (code)""",
            )
            if _run(db, "SELECT count(*) FROM held")[0][0] > HELD:
                yield from _drained(db)
    yield from _drained(db)
    db.close()


def _reader(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatchReader | None:
    first = next(batches, None)
    if first is None:
        return None

    def every():
        yield first
        yield from batches

    return pa.RecordBatchReader.from_batches(first.schema, every())


def _kept(min_docs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's terms that enough documents of their language hold: n by source, and under a null source in all."""
        reader = _reader(batches)
        if reader is None:
            return
        db = _database()
        db.register("reader", reader)
        _run(db, "CREATE TABLE counts AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM reader GROUP BY ALL")
        _run(db, f"CREATE TABLE whole AS SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= {min_docs}")
        yield from _rows(db, "SELECT lang, source, term, c.n FROM counts c JOIN whole w USING (lang, term) UNION ALL SELECT lang, NULL, term, n FROM whole")
        db.close()

    return released(rows)


#: The division binds looser than sums there.
_SHARE = f"1 + (({SCALE}::HUGEINT * ({{n}} + 2)) // ({{t}}.total + 2 * {{t}}.terms))"
#: A language without terms has no shares.
_NONE = f"CASE WHEN terms > 0 THEN 1 + (({SCALE}::HUGEINT * 2) // (total + 2 * terms)) END"


def _f(p: str, q: str) -> str:
    return f"(((({p}) - ({q})) * (({p}) - ({q}))) // (({p}) + ({q})))"


@released
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, part, item and value of one shard: its share of every pair, and its highest terms.

    Rows with a null term are sums: total of a source (or, source null, of a language) and terms of the language.
    For terms that only one source of a pair has, or neither, p is that of n = 0: their sums follow from counts, so
    only terms that both have are joined.
    """
    reader = _reader(batches)
    if reader is None:
        return
    db = _database()
    db.register("reader", reader)
    _run(db, "CREATE TABLE given AS SELECT lang, source, term, n, terms FROM reader")
    _run(db, f"CREATE TABLE sums AS SELECT DISTINCT lang, source, n AS total, terms, ({_NONE})::BIGINT AS none FROM given WHERE term IS NULL")
    _run(db, f"CREATE TABLE shares AS SELECT lang, source, term, ({_SHARE.format(n='n', t='s')})::BIGINT AS p, none FROM (SELECT lang, source, term, n FROM given WHERE term IS NOT NULL AND source IS NOT NULL) JOIN sums s USING (lang, source)")
    _run(db, f"CREATE TABLE whole AS SELECT g.lang, g.term, ({_SHARE.format(n='g.n', t='s')})::BIGINT AS q FROM given g JOIN sums s ON s.lang = g.lang AND s.source IS NULL WHERE g.term IS NOT NULL AND g.source IS NULL")
    both, none = f"{_f('a.p', 'b.p')} - {_f('a.p', 'b.none')} - {_f('a.none', 'b.p')} + {_f('a.none', 'b.none')}", _f("a.none", "b.none")
    _run(db, f"CREATE TABLE met AS SELECT a.lang, a.source, b.source AS item, sum({both}) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL")
    _run(db, "CREATE TABLE levels AS SELECT lang, source, p, count(*) AS n FROM shares GROUP BY ALL")
    _run(db, f"CREATE TABLE alone AS SELECT a.lang, a.source, b.source AS item, sum(a.n * ({_f('a.p', 'b.none')})) AS value, sum(a.n) AS n FROM levels a JOIN sums b ON a.lang = b.lang AND a.source <> b.source GROUP BY ALL")
    _run(db, "CREATE TABLE vocabulary AS SELECT lang, count(*) AS n FROM whole GROUP BY lang")
    _run(
        db,
        f"""CREATE TABLE pairs AS SELECT a.lang, a.source, b.source AS item,
              coalesce(m.value, 0) + coalesce(x.value, 0) + coalesce(y.value, 0) + coalesce((coalesce(v.n, 0) - coalesce(x.n, 0) - coalesce(y.n, 0)) * ({none}), 0) AS value
            FROM sums a JOIN sums b ON a.lang = b.lang AND a.source < b.source
              LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
              LEFT JOIN alone x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              LEFT JOIN alone y ON y.lang = a.lang AND y.source = b.source AND y.item = a.source
              LEFT JOIN vocabulary v ON v.lang = a.lang""",
    )
    yield from _rows(
        db,
        f"""SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
            UNION ALL SELECT lang, item, 'pair', source, value::BIGINT FROM pairs
            UNION ALL SELECT lang, source, 'term', term, value FROM (
              SELECT s.lang, s.source, s.term, ({_f('s.p', 'w.q')})::BIGINT AS value FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.p > w.q
              QUALIFY row_number() OVER (PARTITION BY s.lang, s.source ORDER BY value DESC, s.term) <= {TOP})""",
    )
    db.close()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """lang, source, term and n of the terms that min_docs rows of their language hold (source null: of the
    language in all), as a written table, and the number of shards that it fits into."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH):
        counts = written(docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long"), "divergence-counts")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SHARD_ROWS))
    kept = counts.repartition(shards, "lang", "term").mapInArrow(_kept(min_docs), "lang string, source string, term string, n long")
    return written(kept, "divergence-kept"), shards


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value and rank, of docs (text, lang, source).

    Part pair: item is each other source of the language, value the sum of f over all its kept terms.  Part term: the
    TOP terms that the source has more of than its language, by f.  Null texts, languages and sources are empty
    ones; repeated rows count as often as they come; sources without terms are compared too; an empty table has no
    rows; further columns are ignored.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept, shards = term_counts(docs, min_docs)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    langs = totals.where("source is null").select("lang", "n", "terms")
    groups = docs.select("lang", "source").distinct().join(totals.where("source is not null").select("lang", "source", "n"), ["lang", "source"], "left")
    groups = groups.join(langs.select("lang", "terms"), "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    sums = written(groups.unionByName(langs.withColumn("source", F.lit(None).cast("string"))), "divergence-sums")
    # Every shard gets all sums by the shuffle: they grow with the sources, not with the documents.  A task may get
    # several shards, and with them as many copies.
    sums = sums.select("lang", "source", F.lit(None).cast("string").alias("term"), "n", "terms", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    rows = kept.select("lang", "source", "term", "n", F.lit(None).cast("long").alias("terms"), F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"))
    rows = rows.unionByName(sums).repartition(shards, "shard").drop("shard")
    parts = written(rows.mapInArrow(_compared, "lang string, source string, part string, item string, value long"), "divergence-parts")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.unionByName(terms)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
p AS (SELECT e.lang, e.source, e.term, e.n, (1 + ((1000000000::HUGEINT * (e.n + 2)) // (e.total + 2 * l.v)))::BIGINT AS p FROM every e JOIN langs l USING (lang)),
q AS (SELECT k.lang, k.term, (1 + ((1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v)))::BIGINT AS q FROM kept k JOIN langs l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}"""
