"""SMILES read into graphs, fragments, clusters of bit sets, merges of byte symbols, and rejected rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import smiles_graph as G
from ..functions.atoms import MASSES
from ..operators import clusters as C
from ..operators import fragments
from ..operators import merges as M
from ..operators.rejects import attempted
from ..sinks import writers
from ..sources import structures
from ..storage import new_path, written
from ._registry import query, read, spread

#: A text for each part: chains, branches, rings, aromatic parts, charged ends, and six kinds that can't be read.
_KINDS = [
    "repeat('C', p_size)",
    "repeat('C(O)', p_size)",
    "concat('C1', repeat('C', p_size), 'C1')",
    "concat(repeat('c1ccccc1.', p_size - 1), 'c1ccccc1')",
    "concat('[NH3+]', repeat('C', p_size), 'C(=O)[O-]')",
    "concat(' OC%11', repeat('C', p_size), '=C%11/C=C/S(=O)(=O)Cl ')",
    "concat('C(', repeat('C', p_size))",
    "concat('C1', repeat('C', p_size))",
    "concat(repeat('C', p_size), '=')",
    "concat(repeat('C', p_size), '[Xx]')",
    "concat(repeat('C', p_size), '~C')",
    "concat(repeat('C', p_size), '(=O)(=O)=O')",
    "repeat(' ', p_size)",
]
_TEXT = "CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_KINDS)) + " END"
# Atoms, bonds, hydrogens and parts of the kinds that can be read, and their carbons, nitrogens, oxygens, sulphurs and chlorines.
_COUNTS = {
    0: ("s", "s - 1", "2 * s + 2", "1", "s", 0, 0, 0, 0),
    1: ("2 * s", "2 * s - 1", "2 * s + 2", "1", "s", 0, "s", 0, 0),
    2: ("s + 2", "s + 2", "2 * s + 4", "1", "s + 2", 0, 0, 0, 0),
    3: ("6 * s", "6 * s", "6 * s", "s", "6 * s", 0, 0, 0, 0),
    4: ("s + 4", "s + 3", "2 * s + 3", "1", "s + 1", 1, 2, 0, 0),
    5: ("s + 9", "s + 9", "2 * s + 3", "1", "s + 4", 0, 3, 1, 1),
}
_ERROR = {6: "branch", 7: "ring", 8: "bond", 9: "bracket", 10: "token", 11: "valence", 12: "empty"}


def _counted(i: int) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in _COUNTS.items()) + " ELSE 0 END"


_MASS = " + ".join(f"({_counted(i)}) * {MASSES[e]}" for i, e in [(2, "H"), (4, "C"), (5, "N"), (6, "O"), (7, "S"), (8, "Cl")])
_GRAPHS_SQL = f"""SELECT p_partkey, CASE k {' '.join(f"WHEN {k} THEN '{e}'" for k, e in _ERROR.items())} END AS error, k < 6 AS valid,
  ({_counted(0)})::INTEGER AS atoms, ({_counted(1)})::INTEGER AS bonds, ({_counted(2)})::INTEGER AS hydrogens, ({_counted(3)})::INTEGER AS parts, round(({_MASS})::DOUBLE, 6) AS mass
FROM (SELECT p_partkey, p_partkey % 13 AS k, p_size AS s FROM part)"""


@query("smiles_graphs", _GRAPHS_SQL)
def smiles_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's graph, or why it has none; masses with implicit hydrogens."""
    g = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", G.graph(F.expr(_TEXT)).alias("g")).select("p_partkey", "g.*")
    return g.select(
        "p_partkey", "error", F.col("error").isNull().alias("valid"), F.size("atoms").alias("atoms"), F.size("bonds").alias("bonds"), G.hydrogens(F.col("atoms")).alias("hydrogens"),
        G.components(F.col("atoms"), F.col("bonds")).alias("parts"), F.round(G.exact_mass(F.col("atoms")), 6).alias("mass"),
    )


@query(
    "smiles_bonds",
    f"""WITH p AS (SELECT p_partkey, p_partkey % 13 AS k, p_size AS s FROM part)
        SELECT p_partkey, i::INTEGER AS a, (i + 1)::INTEGER AS b, 1.0::DOUBLE AS "order" FROM p, range(1, s) r(i) WHERE k = 0
        UNION ALL SELECT p_partkey, i, i + 1, 1.0 FROM p, range(1, s + 2) r(i) WHERE k = 2 UNION ALL SELECT p_partkey, 1, s + 2, 1.0 FROM p WHERE k = 2
        UNION ALL SELECT p_partkey, 6 * j + i, 6 * j + i + 1, 1.5 FROM p, range(0, s) m(j), range(1, 6) r(i) WHERE k = 3 UNION ALL SELECT p_partkey, 6 * j + 1, 6 * j + 6, 1.5 FROM p, range(0, s) m(j) WHERE k = 3
        UNION ALL SELECT p_partkey, 2 * i + 1, 2 * i + 2, 1.0 FROM p, range(0, s) r(i) WHERE k = 1 UNION ALL SELECT p_partkey, 2 * i - 1, 2 * i + 1, 1.0 FROM p, range(1, s) r(i) WHERE k = 1""",
)
def smiles_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bonds of chains, branches and rings."""
    g = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size").where("p_partkey % 13 < 4")).select("p_partkey", G.graph(F.expr(_TEXT)).alias("g"))
    # Of an inner generator Spark makes a filter, for which the graphs would be made once more.
    return g.select("p_partkey", F.inline_outer("g.bonds")).where("a IS NOT NULL")


#: What a part is like: its words, maker, kind and size.
_BITS_SQL = "list_distinct(string_split(p_name, ' ') || [p_brand, p_type, 'size ' || p_size % 10])"


def _butina_sql(cutoff: float) -> str:
    return f"""
WITH RECURSIVE s AS (SELECT p_partkey AS id, {_BITS_SQL} AS bits FROM part),
b AS (SELECT id, len(bits) AS n, unnest(bits) AS bit FROM s),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS c, any_value(x.n) AS n, any_value(y.n) AS m FROM b x JOIN b y ON x.bit = y.bit AND x.id <> y.id GROUP BY 1, 2),
near AS (SELECT a, b FROM met WHERE 1 - c / (n + m - c)::DOUBLE <= {cutoff}),
d AS (SELECT s.id, count(near.b) AS neighbours FROM s LEFT JOIN near ON near.a = s.id GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY neighbours DESC, id) AS rank FROM d),
l AS (SELECT r.rank, r.id, list(o.rank) FILTER (o.rank IS NOT NULL) AS others FROM r LEFT JOIN near ON near.a = r.id LEFT JOIN r o ON o.id = near.b GROUP BY 1, 2),
walk AS (
  SELECT 0::BIGINT AS i, list_transform(range(1, (SELECT count(*) FROM r) + 1), lambda x: 0::BIGINT) AS owner
  UNION ALL
  SELECT l.rank, CASE WHEN owner[l.rank] > 0 THEN owner ELSE list_transform(owner, lambda o, j: CASE WHEN o = 0 AND (j = l.rank OR list_contains(coalesce(l.others, []), j)) THEN l.rank ELSE o END) END
  FROM walk JOIN l ON l.rank = walk.i + 1),
ends AS (SELECT unnest(range(1, len(owner) + 1)) AS rank, unnest(owner) AS owner FROM walk WHERE i = (SELECT count(*) FROM r))
SELECT r.id, c.id AS centre, r.neighbours FROM ends JOIN r USING (rank) JOIN r c ON c.rank = ends.owner"""


def _part_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.col("p_brand"), F.col("p_type"), F.concat(F.lit("size "), (F.col("p_size") % 10).cast("string")))))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), bits.alias("bits"))


@query("cluster_butina", _butina_sql(0.4))
def cluster_butina(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.butina(_part_bits(spark, sf_dir), 0.4)


@query(
    "cluster_split",
    f"""WITH c AS (SELECT centre, count(*) AS size FROM ({_butina_sql(0.2)}) GROUP BY 1),
        u AS (SELECT centre, (sum(size) OVER (ORDER BY size DESC, centre) - size) / sum(size) OVER () AS before FROM c)
        SELECT CASE WHEN before < 0.6 - 1e-12 THEN 'train' WHEN before < 0.8 - 1e-12 THEN 'valid' ELSE 'test' END AS split, count(*) AS clusters, sum(size)::BIGINT AS rows FROM u JOIN c USING (centre) GROUP BY 1""",
)
def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of whole clusters."""
    bits = _part_bits(spark, sf_dir)
    rows = C.cluster_split(bits.select("id"), C.butina(bits, 0.2), [0.6, 0.2, 0.2], ["train", "valid", "test"])
    return rows.groupBy("split").agg(F.count_distinct("centre").alias("clusters"), F.count("*").alias("rows"))


#: A merge table of the words themselves: adjacent letters, then pairs of them, each by how often they stand together.
MERGE_MIN = 20


#: A task's counts of words go on each time there are more words than this.
COUNTED = 1 << 18


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    found = Counter()
    for batch in batches:
        for text in batch.column(0):
            # Bytes are split at white space of ASCII alone.
            found.update((text.as_py() or b"").split())
            if len(found) > COUNTED:
                yield rows()
                found = Counter()
    yield rows()


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words between spaces of all documents, with their number; a task adds up its own before they are shuffled."""
    words = read(spark, sf_dir, "documents").select(F.col("text").cast("binary")).mapInArrow(_counted, "word binary, n bigint")
    return words.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of 2, 3 and 4 bytes of a batch's words, as numbers, with the sum of n."""
    for batch in batches:
        size = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
        data = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
        rest = np.repeat(np.cumsum(size), size) - np.arange(len(data))
        n = np.repeat(batch.column(1).to_numpy(), size)
        for level in range(3):
            at = np.flatnonzero(rest >= level + 2)
            run = data[at]
            for i in range(1, level + 2):
                run = run * 256 + data[at + i]
            order = np.argsort(run)
            first = np.flatnonzero(np.diff(run[order], prepend=-1))
            if len(first):
                columns = [np.full(len(first), level, np.int32), run[order][first], np.add.reduceat(n[at][order], first)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["level", "run", "n"])


def _merge_table(words: DataFrame) -> DataFrame:
    """rank, left and right: two letters, then two and one, then two and two."""
    runs = words.select(F.col("word").cast("binary"), "n").mapInArrow(_runs, "level int, run bigint, n bigint")
    runs = runs.groupBy("level", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= MERGE_MIN)
    text, size = M.lettered(F.unhex(F.lpad(F.hex("run"), 2 * (F.col("level") + 2), F.lit("0")))), F.least(F.lit(2), F.col("level") + 1)
    # A pair is one of a level alone, since its letters say which.
    pairs = runs.select("level", "n", F.substring(text, F.lit(1), size).alias("left"), F.substring(text, size + 1, F.lit(2)).alias("right"))
    return pairs.select(F.struct("level", (-F.col("n")).alias("n"), "left", "right").alias("rank"), "left", "right")


_LETTERS = "".join(M.byte_letters()).replace("'", "''")
_MERGED_SQL = f"""
WITH RECURSIVE w AS (
  SELECT word, n, list_transform(range(0, octet_length(encode(word))), lambda i: substr('{_LETTERS}', ((instr('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 2, 1)))::BIGINT, 1)) AS symbols
  FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) GROUP BY word)),
pairs AS (
  SELECT level, array_to_string(symbols[i:i + a - 1], '') AS l, array_to_string(symbols[i + a:i + a + b - 1], '') AS r, sum(n) AS n
  FROM (SELECT * FROM w, (VALUES (0, 1, 1), (1, 2, 1), (2, 2, 2)) v(level, a, b)), range(1, len(symbols) - a - b + 2) t(i) GROUP BY 1, 2, 3 HAVING sum(n) >= {MERGE_MIN}),
m AS (SELECT l, r, row_number() OVER (ORDER BY min(level), -arg_min(n, level), encode(l), encode(r)) AS rank FROM pairs GROUP BY l, r),
known AS MATERIALIZED (SELECT map_from_entries(list((l || chr(10) || r, rank))) AS ranks, map_from_entries(list((rank, l || r))) AS joined FROM m),
steps AS (
  SELECT word, symbols, list_min(list_transform(range(1, len(symbols)), lambda i: ranks[symbols[i] || chr(10) || symbols[i + 1]])) AS best FROM w, known
  UNION ALL
  SELECT word, s, list_min(list_transform(range(1, len(s)), lambda i: ranks[s[i] || chr(10) || s[i + 1]]))
  FROM (SELECT word, list_reduce(list_transform(symbols, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) > 0 AND ranks[acc[-1] || chr(10) || x[1]] = best THEN acc[:-2] || [acc[-1] || x[1]] ELSE acc || x END) AS s
        FROM steps, known WHERE best IS NOT NULL), known)
SELECT word, array_to_string(symbols, ' ') AS pieces FROM steps WHERE best IS NULL"""


@query("text_merged_symbols", _MERGED_SQL)
def text_merged_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words of the documents in pieces, by merges of their bytes' letters."""
    words = written(_words(spark, sf_dir), "merges-words").withColumn("symbols", M.byte_symbols(F.col("word")))
    return M.merged(spread(words), _merge_table(words)).select("word", F.array_join("symbols", " ").alias("pieces"))


#: Chains of 3 to 14 atoms; some have a ring of the first three.  The receptor is one point by each.
_CHAIN = "CNOSC"
_M = {e: round(MASSES[e] * 10**8) for e in set(_CHAIN)}
_FRAGMENTS_SQL = f"""
WITH p AS (SELECT p_partkey AS k, p_size % 12 + 3 AS n FROM part), a AS (SELECT k, n, i, substr('{_CHAIN}', ((i * 7 + k) % 5 + 1)::INT, 1) AS e FROM p, range(1, 15) r(i) WHERE i <= n),
m AS (SELECT *, CASE e {' '.join(f"WHEN '{e}' THEN {w}" for e, w in _M.items())} END AS w FROM a),
s AS (SELECT x.k, x.n, x.i, sum(y.w) FILTER (y.i <= x.i) AS first, sum(y.w) FILTER (y.i > x.i) AS rest FROM a x JOIN m y ON y.k = x.k WHERE x.i < x.n AND NOT (x.k % 3 = 0 AND x.i < 3) AND (x.i + x.k) % 4 > 0 GROUP BY ALL),
f AS (SELECT s.k, s.i, m.i AS atom, m.e, m.w FROM s JOIN m ON m.k = s.k AND CASE WHEN first >= rest THEN m.i > s.i ELSE m.i <= s.i END),
c AS (SELECT k, i, e, count(*) AS c FROM f GROUP BY ALL),
g AS (SELECT k, i, sum(w) / 1e8 AS mass, count(*) AS heavy, min(atom) AS first_atom FROM f GROUP BY ALL HAVING sum(w) BETWEEN 2000000000 AND 15000000000 AND count(*) <= 6),
h AS (SELECT g.*, (SELECT string_agg(e || c, '' ORDER BY e) FROM c WHERE c.k = g.k AND c.i = g.i) AS formula FROM g WHERE power(1.5 * (first_atom - 1), 2) + 16 <= 36)
SELECT k::INT AS mol, (i - 1)::INT AS bond, round(mass, 6) AS mass, heavy::INT AS heavy, formula FROM h QUALIFY row_number() OVER (PARTITION BY formula ORDER BY k, i) <= 40"""


@query("fragments_within_bounds", _FRAGMENTS_SQL)
def fragments_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of structure records that are written from a table: by mass, heavy atoms, distance and repeats."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 12 + 3).alias("n"))
    each = F.sequence(F.lit(1), F.col("n"))
    atoms = F.transform(each, lambda i: F.struct(i.alias("idx"), F.substring(F.lit(_CHAIN), ((i * 7 + F.col("k")) % 5 + 1).cast("int"), F.lit(1)).alias("symbol"), (1.5 * (i - 1)).alias("x"), (F.col("k") % 3).cast("double").alias("y"), F.lit(0.0).alias("z")))
    chain = F.transform(F.slice(each, F.lit(1), F.col("n") - 1), lambda i: F.struct(i.alias("a"), (i + 1).alias("b"), F.when((i + F.col("k")) % 4 == 0, 2).otherwise(1).alias("order")))
    ring = F.when(F.col("k") % 3 == 0, F.array(F.struct(F.lit(1).alias("a"), F.lit(3).alias("b"), F.lit(1).alias("order")))).otherwise(F.array().cast("array<struct<a: int, b: int, order: int>>"))
    mols = p.select("k", F.col("k").cast("string").alias("title"), atoms.alias("atoms"), F.concat(chain, ring).alias("bonds"))
    blocks = writers.molblock(mols, "k").select(F.col("k"), F.concat("molblock", F.lit("\n$$$$")).alias("value"))
    path = new_path(spark, "file-molecules")
    blocks.select("value").write.text(path)
    read_back = structures.sdf(spark, path).where("error is null").select(F.col("title").cast("int").alias("mol"), "atoms", "bonds")
    receptor = p.select(F.col("k").cast("int").alias("mol"), F.lit(0.0).alias("x"), (F.col("k") % 3).cast("double").alias("y"), F.lit(4.0).alias("z"))
    found = fragments.fragments(read_back, "mol", fragments.Bounds(20.0, 150.0, 1, 6, 6.0, 40), receptor)
    return found.select("mol", "bond", F.round("mass", 6).alias("mass"), "heavy", "formula")


@query(
    "rejected_rows",
    """WITH p AS (SELECT p_partkey, p_size, p_size % 10 AS d FROM part)
        SELECT p_partkey, (p_size // d)::BIGINT AS value, NULL::VARCHAR AS reason FROM p WHERE d > 0 UNION ALL SELECT p_partkey, NULL, 'ZeroDivisionError: integer division or modulo by zero' FROM p WHERE d = 0""",
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all rows that have one, and reasons of the others."""
    rows = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"))
    good, bad = attempted(rows, lambda b: [int(s) // (int(s) % 10) for s in b["p_size"]], "long")
    return good.select("p_partkey", "value", F.lit(None).cast("string").alias("reason")).union(bad.select("p_partkey", F.lit(None).cast("bigint"), "reason"))
