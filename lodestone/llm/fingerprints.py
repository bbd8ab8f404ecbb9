"""Homomorphic multiset fingerprints of documents, in DataFrame operations only.

Each paragraph (between line feeds) is hashed to a wide vector, and a document's fingerprint is the
sum of its paragraphs' vectors, lane by lane, modulo 2**32.  So it doesn't depend on their order,
and inserting or deleting paragraphs adds or subtracts their vectors.  A vector has two parts:

* IDENTITY lanes of 32 bits of the whole paragraph, from four 64-bit hashes that are seeded before they
  read it: equal multisets have equal sums, and two others differ in them unless all four hashes
  collide (they aren't cryptographic: texts can be made to collide on purpose);
* CONTENT lanes that count, over the paragraph's runs of three words, how often a bit of the run's
  64-bit hashes is set; 2 * lane - runs is a sum of random signs, so the scalar product of two such
  vectors estimates the number of common runs, whatever paragraphs they are in.

``likeness`` is twice the estimated common runs over both documents' runs, from 0 to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

IDENTITY, CONTENT = 8, 128
_SEEDS = [0x1F3D5B79, 0x2E4C6A88, 0x3B5D7F91, 0x4A6C8EA2]
_LOW = (1 << 32) - 1
_PAIR = 1 | 1 << 32
#: The ids are cut into so many equal ranges at first, and the documents dealt into as many buckets at most.
CELLS, BUCKETS = 1 << 16, 1 << 19
DOCS_PER_BUCKET = 1000


def runs_of(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and, for each run of three words (shorter at a paragraph's end), the run's two hashes; on a
    paragraph's first run also the paragraph."""
    rows = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph"))
    rows = rows.select(*keys, "paragraph", F.split("paragraph", " ").alias("words"))
    rows = rows.select(*keys, "paragraph", "words", F.posexplode("words").alias("at", "word"))
    run = F.xxhash64("word", F.get("words", F.col("at") + 1), F.get("words", F.col("at") + 2))
    rows = rows.select(*keys, F.when(F.col("at") == 0, F.col("paragraph")).alias("paragraph"), run.alias("run0"))
    return rows.select("*", *[F.xxhash64(F.lit(i), "run0").alias(f"run{i}") for i in range(1, CONTENT // 64)])


def lane_sums() -> list[Column]:
    """Aggregates over runs_of; content lanes are summed in pairs, 32 bits each, which no text of
    under 2 GB overflows."""
    whole = F.col("paragraph").isNotNull()
    out = [F.count("*").alias("runs")]
    for i, seed in enumerate(_SEEDS):
        h = F.when(whole, F.xxhash64(F.lit(seed), "paragraph"))
        out += [F.coalesce(F.sum(h.bitwiseAND(_LOW)), F.lit(0)).alias(f"i{2 * i}"), F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)).alias(f"i{2 * i + 1}")]
    out += [F.sum(F.shiftrightunsigned(f"run{i // 32}", i % 32).bitwiseAND(_PAIR)).alias(f"c{i}") for i in range(CONTENT // 2)]
    return out


def lanes() -> Column:
    """Array of runs, identity lanes and content lanes from the sums."""
    content = [F.col(f"c{i}").bitwiseAND(_LOW) for i in range(CONTENT // 2)] + [F.shiftrightunsigned(f"c{i}", 32) for i in range(CONTENT // 2)]
    return F.array(F.col("runs"), *[F.col(f"i{i}").bitwiseAND(_LOW) for i in range(IDENTITY)], *content)


def insert(lanes_a: Column, lanes_b: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    return F.zip_with(lanes_a, lanes_b, lambda a, b: (a + b).bitwiseAND(_LOW))


def delete(lanes_a: Column, lanes_b: Column) -> Column:
    """The fingerprint of a's paragraphs without those of b."""
    return F.zip_with(lanes_a, lanes_b, lambda a, b: (a - b).bitwiseAND(_LOW))


def as_text(lanes: Column) -> Column:
    """Eight hex digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(lanes_a: Column, lanes_b: Column) -> Column:
    """0 (nothing in common, as far as can be told) to 1 (equal)."""

    def signs(lanes: Column) -> Column:
        return F.transform(F.slice(lanes, IDENTITY + 2, CONTENT), lambda x: (2 * x - F.get(lanes, F.lit(0))).cast("double"))

    def product(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    a, b = signs(lanes_a), signs(lanes_b)
    size = product(a, a) + product(b, b)
    near = F.when(size > 0, 2 * product(a, b) / size).otherwise(F.lit(0.0))
    return F.when(lanes_a == lanes_b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and lanes for each distinct value of keys; its texts count together.

    A null text is an empty one: one empty paragraph.  An empty table gives no rows.
    """
    return runs_of(docs, keys, text).groupBy(*keys).agg(*lane_sums()).select(*keys, lanes().alias("lanes"))


def _cells(ids: DataFrame, most: float):
    """A function that adds to rows with doc_id the cell that it is in, and the cells with their counts.

    Cells are disjoint ranges of the ids, at first equal ones; a cell of more than most rows is cut
    into equal ranges between its own least and greatest id, until each is small or of one id.
    """
    cuts: list[DataFrame] = []

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("cell", F.when(F.col("doc_id").isNull(), "null").otherwise(""))
        for cut in cuts:
            # At most BUCKETS rows and as many as hold more than most documents.
            rows = rows.join(F.broadcast(cut), "cell", "left")
            at = F.least(F.col("n") - 1, F.floor((F.col("doc_id").cast("double") - F.col("low")) / F.col("span") * F.col("n")))
            rows = rows.withColumn("cell", F.when(F.col("n").isNull(), F.col("cell")).otherwise(F.concat("cell", F.lit("/"), at.cast("string")))).drop("low", "span", "n")
        return rows

    while True:
        held = placed(ids).groupBy("cell").agg(F.count("*").alias("held"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        held = written(held, "fingerprint-cells")
        parts = F.least(F.lit(CELLS), F.ceil(F.col("held") / most)) if cuts else F.lit(CELLS)
        span = F.col("high").cast("double") - F.col("low").cast("double")
        heavy = held.where((F.col("held") > 4 * most) if cuts else F.col("cell") == "").where(span > 0)
        if heavy.isEmpty():
            return placed, held
        cuts.append(written(heavy.select("cell", F.col("low").cast("double").alias("low"), span.alias("span"), parts.cast("bigint").alias("n")), "fingerprint-cuts"))


def in_order(docs: DataFrame, docs_per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """doc_id, text, bucket and guard: the documents dealt into buckets of adjacent numeric doc_ids.

    The first rows of each next bucket (after the last: of the first one) stand in a bucket once
    more as guards, so that each document meets the one after it in its own bucket.  Buckets hold
    about equally many documents however the ids are spread; only rows of one doc_id stay together.
    Null doc_ids come first.
    """
    ids = docs.select("doc_id")
    total = ids.count()
    size = max(1, min(docs_per_bucket, total), total // BUCKETS)
    placed, held = _cells(ids, size)
    first = F.struct(F.col("cell") != "null", "low")
    # The cells are as many as the buckets, but for a constant: BUCKETS at most.
    upto = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    cells = held.select("cell", first.alias("first"), F.floor(F.coalesce(F.sum("held").over(upto), F.lit(0)) / size).cast("int").alias("bucket"))
    cells = written(cells, "fingerprint-buckets")
    firsts = cells.groupBy("bucket").agg(F.min("first").alias("first"))
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    guards = firsts.select(F.col("first.low").alias("guard_id"), before.alias("guarded")).distinct()
    rows = placed(docs.select("doc_id", "text"))
    rows = rows.join(F.broadcast(cells.select("cell", "bucket")), "cell").join(F.broadcast(guards), F.col("doc_id").eqNullSafe(F.col("guard_id")), "left")
    places = F.array(F.struct(F.col("bucket"), F.lit(False).alias("guard")), F.struct(F.col("guarded").alias("bucket"), F.lit(True).alias("guard")))
    return rows.select("doc_id", "text", F.inline(F.filter(places, lambda p: p["bucket"].isNotNull())))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last floor(n_chars / 2)
    characters are the first as many of the next document (ascending doc_id, after the last the first).

    docs needs doc_id (a number) and text; further columns are ignored.  Null texts are empty, null
    doc_ids come first, rows with one doc_id follow each other by text, and repeated rows are all
    returned.  The next document of a single one is itself.  An empty table gives no rows.
    """
    order = Window.partitionBy("bucket").orderBy("guard", "doc_id", "text")
    rows = in_order(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("bucket", "guard", "doc_id", "text", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("next"))
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("bucket", "guard", "doc_id", "nth", chars.cast("bigint").alias("n_chars"), "text", F.when(~F.col("guard"), edited).alias("edited"))
    # Fixed-width keys: the digest as four numbers.
    digest = F.sha2("edited", 256)
    parts = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"s{i}") for i in range(4)]
    rows = rows.select("bucket", "guard", "doc_id", "nth", "n_chars", *parts, F.posexplode(F.when(F.col("guard"), F.array("text")).otherwise(F.array("text", "edited"))).alias("version", "body"))
    keys = ["bucket", "guard", "doc_id", "nth", "n_chars", "s0", "s1", "s2", "s3"]
    found = runs_of(rows, [*keys, "version"], "body").groupBy(*keys, "version").agg(*lane_sums()).select(*keys, "version", lanes().alias("lanes"))
    own, other = (F.first(F.when(F.col("version") == v, F.col("lanes")), ignorenulls=True).alias(name) for v, name in ((0, "own"), (1, "other")))
    found = found.groupBy(*keys).agg(own, other)
    found = found.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("nth"))).where(~F.col("guard"))
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"s{i}")), 16, "0") for i in range(4)])
    return found.select("doc_id", "n_chars", sha.alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
