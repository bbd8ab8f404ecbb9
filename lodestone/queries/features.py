"""Grids of receptor and parent, poolings, losses, distribution functions and batches of features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atoms as A
from ..functions import collating as C
from ..functions import owa
from ..functions import registry as G
from ..functions import statistics as ST
from ..functions.vectors import doubles, total
from ..operators import retrieval, sequences
from ..operators import voxels as V
from ._registry import query, read, spread
from .collating import SMILES, _smiles
from .retrieval import E, vectors
from .tokens import IDS, h_sql, ids
from .voxels import ATOMS, MASK, RADIUS, RES, W, atoms

U = "(({h}) + 0.5) / 4294967296.0::DOUBLE"


@query(
    "atom_random_quaternion",
    f"""WITH u AS (SELECT vec_id, {", ".join(f"{U.format(h=h_sql(f'(vec_id * 8 + {i})'))} AS u{i}" for i in range(4))} FROM embeddings),
n AS (SELECT vec_id, sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) AS a, sqrt(-2 * ln(u0)) * sin(2 * pi() * u1) AS b, sqrt(-2 * ln(u2)) * cos(2 * pi() * u3) AS c, sqrt(-2 * ln(u2)) * sin(2 * pi() * u3) AS d FROM u), l AS (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS l FROM n)
SELECT vec_id, round(a / l, 9) AS qw, round(b / l, 9) AS qx, round(c / l, 9) AS qy, round(d / l, 9) AS qz FROM l""",
)
def quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.random_quaternion(F.col("vec_id"))
    return read(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 9).alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)])


@query("atom_connectors", f"WITH {ATOMS} SELECT item, item * 1.5::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM (SELECT DISTINCT item FROM a WHERE item < 3) UNION ALL SELECT item, round(x, 9), round(y, 9), round(z, 9) FROM a WHERE num = 1 AND item >= 3")
def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydrogens stand for dummy atoms; the first three items have a given point."""
    rows = atoms(spark, sf_dir).withColumn("num", F.when(F.col("num") == 1, 0).otherwise(F.col("num")))
    given = rows.where("item < 3").select("item").distinct().select("item", (F.col("item") * 1.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return V.connectors(rows, given).select("item", *[F.round(c, 9).alias(c) for c in "xyz"])


LIGAND = "CASE WHEN num <= 1 THEN 0 WHEN num = 6 THEN 1 WHEN num = 8 THEN 2 WHEN num = 7 THEN 4 ELSE 8 END"
GRID = f"""{ATOMS}, o AS (SELECT item, arg_min(x, vec_id) AS cx, arg_min(y, vec_id) AS cy, arg_min(z, vec_id) AS cz FROM a GROUP BY 1),
m AS (SELECT item, x - cx AS x, y - cy AS y, z - cz AS z, {RADIUS} AS r, CASE WHEN vec_id % 3 < 2 THEN {MASK} ELSE {LIGAND} END AS mask, CASE WHEN vec_id % 3 < 2 THEN 0 ELSE 5 END AS first FROM a JOIN o USING (item)),
b AS (SELECT m.*, k::INT AS bit FROM m, range(6) r(k) WHERE (mask >> k::INT) & 1 = 1), c AS (SELECT item, first + bit AS channel, ix, iy, iz, (x - (ix - {W / 2}) * {RES}) ** 2 + (y - (iy - {W / 2}) * {RES}) ** 2 + (z - (iz - {W / 2}) * {RES}) ** 2 AS d2, r FROM b, range({W}) p(ix), range({W}) q(iy), range({W}) s(iz)),
g AS (SELECT item, channel, ix, iy, iz, sum(exp(-2 * d2 / (r * r))) AS density FROM c WHERE d2 <= r * r GROUP BY ALL)"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, V.VoxelParams]:
    rows = atoms(spark, sf_dir)
    centre = rows.groupBy("item").agg(*[F.min_by(c, "vec_id").alias("c" + c) for c in "xyz"])
    parent = rows.where("vec_id % 3 = 2").withColumn("mask", A.heavy_mask(F.col("num"), A.LIGAND))
    params = V.VoxelParams(W, RES, "exp", "sum", 1.0)
    return V.receptor_and_parent(rows.where("vec_id % 3 < 2"), parent, centre, params), params


@query("voxel_receptor_and_parent", f"WITH {GRID} SELECT item, channel::INT AS channel, ix::INT AS x, iy::INT AS y, iz::INT AS z, round(density, 9) AS density FROM g")
def receptor_and_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of an item's atoms are its receptor, the others its parent, seen from its first atom."""
    return _grid(spark, sf_dir)[0].withColumn("density", F.round("density", 9))


@query(
    "voxel_pooled",
    f"""WITH {GRID}, s AS (SELECT *, row_number() OVER (PARTITION BY item, channel ORDER BY density DESC) - 1 AS i FROM g), q AS (SELECT * FROM (VALUES ('owa1', 0.0::DOUBLE, 0.5::DOUBLE), ('owa2', 0.3, 0.8)) t(name, a, b))
SELECT item, channel::INT AS channel, name, round(sum(density * (greatest(0, least(1, ((i + 1) / {W**3} - a) / (b - a))) - greatest(0, least(1, (i / {W**3} - a) / (b - a))))), 9) AS value FROM s, q GROUP BY 1, 2, 3 UNION ALL SELECT item, channel::INT, 'mean', round(sum(density) / {W**3}, 9) FROM g GROUP BY 1, 2""",
)
def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, params = _grid(spark, sf_dir)
    out = None
    for name in ("mean", "owa1", "owa2"):
        part = V.pooled(grid, params, owa.operator(name)).select("item", "channel", F.lit(name).alias("name"), F.round("value", 9).alias("value"))
        out = part if out is None else out.union(part)
    return out


@query("sequence_mean_of_tokens", f"{E}, p AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth, count(*) OVER (PARTITION BY label) AS n FROM e), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM p WHERE nth > 0 AND nth < n - 1) SELECT label, pos::INT AS pos, round(avg(x), 9) AS value FROM x GROUP BY 1, 2")
def mean_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label are the tokens of its sequence: all but the first and the last mark."""
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    rows = vectors(spark, sf_dir).withColumn("at", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count("*").over(w))
    mean = retrieval.mean_vector(rows.where("at > 0 and at < n - 1"), ["label"], "vector")
    return mean.select("label", F.posexplode("vector").alias("pos", "value")).select("label", "pos", F.round("value", 9).alias("value"))


@query("vectors_joined", f"{E}, p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY 1, 2), s AS (SELECT label, list(x ORDER BY pos) AS m FROM m GROUP BY 1) SELECT vec_id, len(v || m || v[1:8])::INT AS width, round(list_sum(list_transform(v || m || v[1:8], lambda x, i: x * i)), 6) AS weighed FROM e JOIN s USING (label)")
def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's vector, that of its sequence (made once for each), and a third one, side by side."""
    rows = vectors(spark, sf_dir)
    mean = retrieval.mean_vector(rows, ["label"], "vector").withColumnRenamed("vector", "mean")
    rows = rows.join(mean, "label").select(F.col("id").alias("vec_id"), F.concat("vector", "mean", F.slice("vector", 1, 8)).alias("v"))
    return rows.select("vec_id", F.size("v").alias("width"), F.round(total(F.transform("v", lambda x, i: x * (i + 1))), 6).alias("weighed"))


@query(
    "loss_of_tasks",
    f"""{E}, l AS (SELECT vec_id, label AS batch, v[1:8] AS a, v[9:12] AS b, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE vec_id % 8 END AS y, vec_id % 2 AS z FROM e),
c AS (SELECT batch, CASE WHEN y >= 0 THEN -ln(exp(a[y + 1]) / list_sum([exp(x) FOR x IN a])) END AS masked, -ln(exp(b[z + 1]) / (exp(b[1]) + exp(b[2]))) AS same, ((b[3] - z) ** 2 + (b[4] - 1) ** 2) / 2 AS phys FROM l) SELECT batch, round(avg(masked) + avg(same) + avg(phys), 9) AS loss FROM c GROUP BY 1""",
)
def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked tokens (a third of them ignored), a pair's class and two measures, each averaged and then added."""
    k = F.col("id")
    v = F.col("vector")
    z = (k % 2).cast("int")
    masked = ST.cross_entropy(F.slice(v, 1, 8), F.when(k % 3 == 0, -1).otherwise(k % 8).cast("int"))
    same = ST.cross_entropy(F.slice(v, 9, 2), z)
    phys = ST.squared_error(F.slice(v, 11, 2), F.array(z.cast("double"), F.lit(1.0)))
    return vectors(spark, sf_dir).groupBy(F.col("label").alias("batch")).agg(F.round(F.avg(masked) + F.avg(same) + F.avg(phys), 9).alias("loss"))


@query(
    "cdf_normalised",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem), c AS (SELECT *, least(45, greatest(5, q)) AS x FROM v)
SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, (x - 1) / 49)), 9) AS uniform, round(CASE WHEN x > 2 THEN 1 - exp(-(x - 2) / 10) ELSE 0 END, 9) AS expon, round(1 / (1 + exp(-(x - 25) / 7)), 9) AS logistic, round(CASE WHEN x < 25 THEN 0.5 * exp((x - 25) / 9) ELSE 1 - 0.5 * exp(-(x - 25) / 9) END, 9) AS laplace, round(exp(-exp(-(x - 20) / 8)), 9) AS gumbel_r FROM c""",
)
def cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {"uniform": [1.0, 49.0], "expon": [2.0, 10.0], "logistic": [25.0, 7.0], "laplace": [25.0, 9.0], "gumbel_r": [20.0, 8.0]}
    return spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", *[F.round(ST.cdf_normalised(F.col("l_quantity"), n, p, 5, 45), 9).alias(n) for n, p in params.items()])


# Whole shapes and even degrees of freedom have finite sums, t with 3 an arc tangent.
_ERLANG = "1 - exp(-({x})) * ({sum})"
_FAMILIES = {
    "gamma": ([4.0, 1.0, 6.0], _ERLANG.format(x="(x - 1) / 6", sum=" + ".join(f"pow((x - 1) / 6, {i}) / {math.factorial(i)}" for i in range(4)))),
    "chi2": ([24.0, 2.0, 1.5], _ERLANG.format(x="(x - 2) / 3", sum=" + ".join(f"pow((x - 2) / 3, {i}) / {math.factorial(i)}" for i in range(12)))),
    "beta": ([3.0, 5.0, 0.0, 60.0], " + ".join(f"{math.comb(7, j)} * pow(x / 60, {j}) * pow(1 - x / 60, {7 - j})" for j in range(3, 8))),
    "f": ([6.0, 4.0, 1.0, 20.0], " + ".join(f"{math.comb(4, j)} * pow(6 * (x - 1) / (6 * (x - 1) + 80), {j}) * pow(80 / (6 * (x - 1) + 80), {4 - j})" for j in range(3, 5))),
    "t": ([3.0, 25.0, 5.0], "0.5 + (((x - 25) / 5 / sqrt(3)) / (1 + pow((x - 25) / 5, 2) / 3) + atan((x - 25) / 5 / sqrt(3))) / pi()"),
    "invgamma": ([2.0, 0.0, 30.0], "exp(-30 / x) * (1 + 30 / x)"),
    "weibull_min": ([1.5, 0.0, 20.0], "1 - exp(-pow(x / 20, 1.5))"),
}


@query("cdf_incomplete_functions", f"""SELECT l_orderkey, l_linenumber, {", ".join(f"round({sql}, 10) AS {name}" for name, (_, sql) in _FAMILIES.items())} FROM (SELECT l_orderkey, l_linenumber, least(45, greatest(5, l_quantity))::DOUBLE AS x FROM lineitem)""")
def cdf_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that need the incomplete gamma and beta functions."""
    return spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", *[F.round(ST.cdf_normalised(F.col("l_quantity").cast("double"), n, p, 5, 45), 10).alias(n) for n, (p, _) in _FAMILIES.items()])


@query("fingerprint_folded", f"WITH {IDS}, i AS (SELECT doc_id, unnest(ids) * 2654435761 % 4294967296 AS idx FROM t), c AS (SELECT doc_id, idx, count(*) AS n FROM i GROUP BY 1, 2), f AS (SELECT doc_id, idx % 16 AS k, sum(n) AS n FROM c GROUP BY 1, 2) SELECT doc_id, array_to_string([coalesce(list_sum([x.n FOR x IN l IF x.k = j]), 0)::BIGINT FOR j IN range(16)], ',') AS counts, array_to_string([(len([1 FOR x IN l IF x.k = j]))::BIGINT FOR j IN range(16)], ',') AS bits FROM (SELECT doc_id, list({'{'}'k': k, 'n': n{'}'}) AS l FROM f GROUP BY 1)")
def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse fingerprint of hashed tokens folded to 16 places, as counts and as bits."""
    sparse = ids(spark, sf_dir).select("doc_id", F.explode("ids").alias("x")).groupBy("doc_id", F.pmod(F.col("x").cast("bigint") * 2654435761, F.lit(4294967296)).alias("index")).agg(F.count("*").alias("n"))
    return retrieval.folded(sparse, "doc_id", 16).select("doc_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("counts", "bits")])


@query(
    "batches_of_valid_rows",
    f"WITH {SMILES}, v AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS nth, count(*) OVER () AS n FROM m WHERE p_partkey % 7 NOT IN (3, 6)) SELECT (nth + t * n) // 16 AS batch, (nth + t * n) % 16 AS at, p_partkey FROM v, range(40) r(t) WHERE nth + t * n < 16 * 300",
)
def batches_of_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 batches of 16 from the legal texts alone, which come again when they run out."""
    from ..functions import smiles as SM

    rows = _smiles(spark, sf_dir).select("p_partkey", SM.legal_ids(F.col("smiles"), 80, ["Na"])["valid"].alias("valid"))
    return sequences.valid_batches(rows, ["p_partkey"], "valid", 16, 300).select("batch", "at", "p_partkey")


@query("gathered_predictions", "WITH p AS (SELECT s_suppkey AS k, list_transform(range(s_suppkey % 6 + 1), lambda i: (s_suppkey * 10 + i)::INT) AS v FROM supplier), w AS (SELECT max(len(v)) AS w FROM p) SELECT k, array_to_string(v || list_transform(range(w - len(v)), lambda i: -100), ',') AS v FROM p, w")
def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three workers put together, cut to the number of examples, filled up with -100.

    Each worker has made some of its examples once more, behind the others, so that all have as many.
    """
    v = F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 6).cast("int")), lambda i: (F.col("s_suppkey") * 10 + i).cast("int"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), v.alias("v"))
    n = rows.count()
    again = rows.where("k < 9").withColumn("k", F.col("k") + (1 << 40))
    every = rows.union(again)
    out = sequences.gathered([every.where(F.col("k") % 3 == i) for i in range(3)], ["k"], "v", n)
    return out.select("k", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"))


_LAYERS = "l AS (SELECT vec_id, vec_id % 7 > 0 AS valid, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, valid, k::INT AS k, h::INT AS h, (v[(4 - k) * 12 + h + 1] + v[(4 - k) * 12 + 4 + h + 1] + v[(4 - k) * 12 + 8 + h + 1]) / 3 AS m FROM l, range(1, 5) a(k), range(4) b(h)), p AS (SELECT vec_id, valid, h::INT AS h, v[49 + h] AS p FROM l, range(4) b(h))"


@query(
    "embedding_poolings",
    f"""WITH {_LAYERS}, o AS (SELECT 'average-' || k AS kind, vec_id, valid, h AS place, m AS x FROM x UNION ALL SELECT 'average-sum-' || n, vec_id, valid, h, sum(m) FROM x, (SELECT unnest([2, 4]) AS n) WHERE k <= n GROUP BY ALL
UNION ALL SELECT 'average-cat-' || n, vec_id, valid, (n - k) * 4 + h, m FROM x, (SELECT unnest([2, 4]) AS n) WHERE k <= n UNION ALL SELECT 'pooled', vec_id, valid, h, p FROM p UNION ALL SELECT 'average-1-cat-pooled', vec_id, valid, h, m FROM x WHERE k = 1 UNION ALL SELECT 'average-1-cat-pooled', vec_id, valid, 4 + h, p FROM p)
SELECT kind, vec_id, count(*)::INT AS width, round(sum(CASE WHEN valid THEN x * (place + 1) ELSE 0 END), 8) AS weighed FROM o GROUP BY 1, 2""",
)
def poolings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers of three tokens of four numbers, and a pooled output, cut from a vector; one in seven is invalid."""
    v = doubles(F.col("embedding"))
    layers = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: F.slice("v", k * 12 + t * 4 + 1, F.lit(4))))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", layers.alias("layers"), F.slice("v", 49, 4).alias("pooled"))
    each = [F.struct(F.lit(k).alias("kind"), ST.embedding(k, F.col("layers"), F.col("pooled"), F.col("vec_id") % 7 > 0).alias("e")) for k in ST.POOLINGS]
    rows = rows.select("vec_id", F.inline(F.array(*each)))
    return rows.select("kind", "vec_id", F.size("e").alias("width"), F.round(total(F.transform("e", lambda x, i: x * (i + 1))), 8).alias("weighed"))


@query("label_vocabulary", "SELECT array_to_string(list_sort(list_distinct(list(x))), ',') AS labels FROM (SELECT lang AS x FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'xx' UNION ALL SELECT 'en')")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels known so far and those of new examples."""
    return retrieval.labels_of(read(spark, sf_dir, "documents"), "lang", ["xx", "en"]).select(F.array_join("labels", ",").alias("labels"))


@query("fragment_counts", "SELECT p_type AS fragment, count(*) AS n, rank() OVER (ORDER BY count(*) DESC)::INT AS place FROM part GROUP BY 1")
def fragment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("fragment")).agg(F.count("*").alias("n"))
    # One row a fragment.
    return counts.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))


@query("bench_columns", """SELECT p_name AS "SMILES", p_size AS "p_size", p_retailprice AS "retail_price" FROM part WHERE p_size = 1 AND NOT contains(p_type, 'BRASS')""")
def bench_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark's table by the names that are used everywhere, for tasks of one column that don't come from one source."""
    from ..sources.tables import bench, single_tasks

    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("smiles"), F.col("p_size").alias("p size"), F.col("p_retailprice").alias("retail price"), "p_type")
    return bench(single_tasks(rows, "`p size`", "p_type", "BRASS")).select("SMILES", "p_size", "retail_price")


@query("fuzzy_symmetric", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, len(embedding) AS n FROM embeddings), s AS (SELECT vec_id, n, 1 AS sign, greatest(x, 0) AS x FROM v UNION ALL SELECT vec_id, n, -1, greatest(-x, 0) FROM v),
i AS (SELECT *, row_number() OVER (PARTITION BY vec_id, sign ORDER BY x DESC) - 1 AS i FROM s) SELECT vec_id, round(sum(sign * x * (pow((i + 1) / n, 2) - pow(i / n, 2))), 8) AS choquet FROM i GROUP BY 1""")
def symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(owa.choquet_symmetric(doubles(F.col("embedding")), 2.0), 8).alias("choquet"))


@query("fingerprint_registry", """WITH e AS (SELECT vec_id, [(x > 0.5)::INT FOR x IN embedding] AS a, [(x < -0.5)::INT FOR x IN embedding] AS b FROM embeddings) SELECT 'rdk10' AS kind, vec_id, array_to_string(a, '') AS bits FROM e UNION ALL SELECT 'rdk10_x_morgan', vec_id, array_to_string(list_transform(a, lambda x, i: greatest(x, b[i])), '') FROM e UNION ALL SELECT 'language_model', vec_id, array_to_string(list_reverse(a), '') FROM e""")
def fingerprint_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = lambda test: F.transform("embedding", lambda x: test(x).cast("int"))
    a = bits(lambda x: x > 0.5)
    columns = {"rdk10": a, "morgan": bits(lambda x: x < -0.5), "language_model": F.reverse(a)}
    each = [F.struct(F.lit(k).alias("kind"), F.array_join(F.transform(G.fingerprint(k, columns), lambda x: x.cast("string")), "").alias("bits")) for k in ("rdk10", "rdk10_x_morgan", "language_model")]
    return read(spark, sf_dir, "embeddings").select("vec_id", F.inline(F.array(*each))).select("kind", "vec_id", "bits")


@query("atom_featurizers", f"WITH {ATOMS} SELECT vec_id, 'receptor' AS kind, {MASK} AS mask, {RADIUS} AS radius FROM a UNION ALL SELECT vec_id, 'ligand', {LIGAND}, {RADIUS} FROM a UNION ALL SELECT vec_id, 'carbons', (num = 6)::INT, 2.0 FROM a")
def featurizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two of the library, and one that a user adds."""
    G.FEATURIZERS["carbons"] = lambda n: ((n == 6).cast("int"), F.lit(2.0))
    each = [F.struct(F.lit(k).alias("kind"), G.featurized(k, F.col("num")).alias("f")) for k in ("receptor", "ligand", "carbons")]
    rows = atoms(spark, sf_dir).select("vec_id", "num").select("vec_id", F.inline(F.array(*each)))
    return rows.select("vec_id", "kind", F.col("f.mask").cast("int").alias("mask"), F.col("f.radius").cast("double").alias("radius"))


@query("featurizer_validity", "SELECT vec_id, vec_id % 4 > 0 AS valid, round(CASE WHEN vec_id % 4 > 0 THEN list_sum(embedding::DOUBLE[]) ELSE 0 END, 8) AS total FROM embeddings")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", G.validated(doubles(F.col("embedding")), F.col("vec_id") % 4 > 0, 64).alias("f"))
    return rows.select("vec_id", "f.valid", F.round(total(F.col("f.features")), 8).alias("total"))


@query("descriptor_subset", "SELECT p_brand AS name FROM (SELECT DISTINCT p_brand FROM part) ORDER BY 1 LIMIT 7")
def descriptor_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands stand for descriptors, of which there are few."""
    names = [r["p_brand"] for r in read(spark, sf_dir, "part").select("p_brand").distinct().collect()]
    return spark.createDataFrame([(n,) for n in G.descriptors(names, 7)], "name string")


@query(
    "examples_of_pairs",
    f"""WITH {IDS}, n AS (SELECT doc_id, ids, row_number() OVER (ORDER BY doc_id) - 1 AS nth, count(*) OVER () AS total FROM t WHERE ids IS NOT NULL), d AS (SELECT doc_id, ids[1 : doc_id % 40] AS a, ids[doc_id % 40 + 1 : doc_id % 40 + 20] AS own, {h_sql('doc_id', 1)} % 3 AS kind, (nth + 1 + {h_sql('doc_id', 2)} % (total - 1)) % total AS other FROM n),
p AS (SELECT d.doc_id, a, kind, CASE kind WHEN 1 THEN own WHEN 2 THEN n.ids[1:20] END AS b FROM d JOIN n ON n.nth = other), v AS (SELECT *, len(a) BETWEEN 1 AND 30 AND (b IS NULL OR len(b) BETWEEN 1 AND 30) AS valid FROM p)
SELECT doc_id, valid, CASE WHEN valid AND kind = 1 THEN 1 ELSE 0 END::INT AS same, CASE WHEN valid THEN len(a) + 2 + CASE WHEN b IS NULL THEN 0 ELSE len(b) + 1 END ELSE 0 END::BIGINT AS n, CASE WHEN valid THEN 101 + 102 * (1 + (b IS NOT NULL)::INT) + list_sum(a) + coalesce(list_sum(b), 0) ELSE 0 END::BIGINT AS total FROM v""",
)
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text alone, with what follows in its document, or with the beginning of another one; too long or empty ones are zeros."""
    from ..functions.tokens import portable_hash

    rows = sequences.numbered(ids(spark, sf_dir).where("ids is not null"), ["doc_id"])
    n = rows.count()
    k = (F.col("doc_id") % 40).cast("int")
    rows = rows.withColumn("kind", portable_hash(F.col("doc_id"), 1) % 3).withColumn("other", F.pmod(F.col("nth") + 1 + portable_hash(F.col("doc_id"), 2) % (n - 1), F.lit(n)))
    rows = rows.join(rows.select(F.col("nth").alias("other"), F.slice("ids", 1, 20).alias("foreign")), "other")
    b = F.when(F.col("kind") == 1, F.slice(F.col("ids"), k + 1, F.lit(20))).when(F.col("kind") == 2, F.col("foreign"))
    rows = rows.select("doc_id", C.pair_sample(F.slice(F.col("ids"), F.lit(1), k), b, F.col("kind") == 1, 32, 101, 102).alias("s"))
    size = F.size(F.filter("s.input_ids", lambda x: x != 0))
    return rows.select("doc_id", "s.valid", "s.same", size.cast("bigint").alias("n"), total(doubles(F.col("s.input_ids"))).cast("bigint").alias("total"))
