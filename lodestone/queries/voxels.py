"""Featurised atoms and voxel grids; atoms are made from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atoms as A
from ..operators import voxels as V
from ..sinks import writers
from ..sources import structures
from ..storage import new_path
from ._registry import query, read

ATOMS = """a AS (SELECT label AS item, vec_id, 8 * embedding[1]::DOUBLE AS x, 8 * embedding[2]::DOUBLE AS y, 8 * embedding[3]::DOUBLE AS z,
[6, 7, 8, 16, 1][1 + (vec_id % 5)::INT] AS num FROM embeddings)"""
MASK = "CASE WHEN num <= 1 THEN 0 WHEN num = 6 THEN 1 WHEN num = 8 THEN 2 WHEN num = 7 THEN 4 WHEN num = 16 THEN 8 ELSE 16 END"
RADIUS = "CASE num WHEN 6 THEN 1.7 WHEN 7 THEN 1.55 WHEN 8 THEN 1.52 WHEN 16 THEN 1.8 WHEN 1 THEN 1.1 ELSE 0 END::DOUBLE"
W, RES, SCALE = 8, 1.0, 1.0


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = F.get(F.array(*map(F.lit, [6, 7, 8, 16, 1])), (F.col("vec_id") % 5).cast("int"))
    xyz = [(8 * F.get("embedding", F.lit(i)).cast("double")).alias(c) for i, c in enumerate("xyz")]
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("item"), "vec_id", *xyz, num.alias("num"))
    return rows.withColumns({"mask": A.heavy_mask(F.col("num"), A.RECEPTOR), "radius": A.vdw_radius(F.col("num"))})


@query("atom_features", f"WITH {ATOMS} SELECT vec_id, num, {MASK} AS mask, {RADIUS} AS radius, CASE num WHEN 6 THEN 1 WHEN 8 THEN 2 WHEN 7 THEN 4 ELSE CASE WHEN num > 1 THEN 8 ELSE 0 END END AS ligand, CASE num WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS atomic FROM a")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("num")
    return atoms(spark, sf_dir).select("vec_id", "num", "mask", "radius", A.heavy_mask(n, A.LIGAND).alias("ligand"), A.atomic_mask(n, [6, 7]).alias("atomic"))


@query("atom_centers", f"WITH {ATOMS} SELECT item, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS num_atoms, sum((num > 1)::INT)::BIGINT AS num_heavy_atoms FROM a GROUP BY 1")
def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atoms(spark, sf_dir)
    counts = rows.groupBy(F.col("item").alias("of")).agg(F.count("*").alias("num_atoms"), F.count_if(F.col("num") > 1).alias("num_heavy_atoms"))
    return V.centers(rows).join(counts, F.col("item") == F.col("of")).select("item", *[F.round(c, 9).alias(c) for c in "xyz"], "num_atoms", "num_heavy_atoms")


#: 120 degrees about (1, 1, 1).
Q = (0.5, 0.5, 0.5, 0.5)


@query(
    "atom_rotation",
    f"WITH {ATOMS} SELECT vec_id, round(z, 9) AS x, round(x, 9) AS y, round(y, 9) AS z FROM a",
)
def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = A.rotated(tuple(map(F.lit, Q)), *map(F.col, "xyz"))
    return atoms(spark, sf_dir).select("vec_id", *[F.round(c + 0.0, 9).alias(n) for c, n in zip(new, "xyz", strict=True)])


def _sql(shape: str, acc: str, turned: bool) -> str:
    value = {
        "exp": "CASE WHEN d2 <= r * r THEN exp(-2 * d2 / (r * r)) END",
        "sphere": "CASE WHEN d2 <= r * r THEN 1.0::DOUBLE END",
        "cube": "1.0::DOUBLE",
        "gaussian": "CASE WHEN sqrt(d2) <= r THEN exp(-2 * d2 / (r * r)) WHEN sqrt(d2) <= 1.5 * r THEN exp(-2.0::DOUBLE) * (4 * d2 / (r * r) - 12 * sqrt(d2) / r + 9) END",
        "lj": "CASE WHEN d2 = 0 THEN 1.0::DOUBLE WHEN sqrt(d2) <= 1.5 * r THEN 1 - exp(-pow(r / sqrt(d2), 12)) END",
        "discrete": f"CASE WHEN abs(dx) < {RES / 2} AND abs(dy) < {RES / 2} AND abs(dz) < {RES / 2} THEN 1.0::DOUBLE END",
    }[shape]
    # The grid's point (gx, gy, gz) turns to (gz, gx, gy).
    point = ("gz", "gx", "gy") if turned else ("gx", "gy", "gz")
    return f"""WITH {ATOMS}, f AS (SELECT *, {MASK} AS mask, {SCALE} * {RADIUS} AS r FROM a), g AS (SELECT ix, iy, iz, (ix - {W / 2}) * {RES}::DOUBLE AS gx, (iy - {W / 2}) * {RES}::DOUBLE AS gy, (iz - {W / 2}) * {RES}::DOUBLE AS gz
FROM range({W}) t(ix), range({W}) u(iy), range({W}) v(iz)), d AS (SELECT item, mask, r, ix, iy, iz, x - {point[0]} AS dx, y - {point[1]} AS dy, z - {point[2]} AS dz FROM f, g WHERE mask <> 0),
e AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM d WHERE abs(dx) <= r * r AND abs(dy) <= r * r AND abs(dz) <= r * r), v AS (SELECT item, mask, ix, iy, iz, {value} AS value FROM e)
SELECT item, k::INT AS channel, ix::INT AS x, iy::INT AS y, iz::INT AS z, round({acc}(value), 8) AS density FROM v, range(5) t(k) WHERE value IS NOT NULL AND (mask >> k::INT) & 1 = 1 GROUP BY ALL"""


def _voxels(shape: str, acc: str, turned: bool):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = atoms(spark, sf_dir)
        if turned:
            rows = rows.withColumns(dict(zip(("qw", "qx", "qy", "qz"), map(F.lit, Q), strict=True)))
        grid = V.voxelize(rows, V.VoxelParams(W, RES, shape, acc, SCALE), rotation=turned)
        return grid.withColumn("density", F.round("density", 8))

    return q


for _shape in A.SHAPES:
    for _acc in ("sum", "max"):
        query(f"voxel_{_shape}_{_acc}", _sql(_shape, _acc, False))(_voxels(_shape, _acc, False))
query("voxel_exp_rotated", _sql("exp", "sum", True))(_voxels("exp", "sum", True))


@query("sink_voxel_atoms", f"SELECT item::BIGINT AS item, channel, (1 + count(*) FILTER (density > 0.5))::BIGINT AS atoms, round(coalesce(sum((x - {W / 2}) * {RES}) FILTER (density > 0.5), 0), 3) AS x FROM ({_sql('exp', 'sum', False)}) GROUP BY 1, 2")
def voxel_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid as the atoms of structure files, one a channel, read back; each has one at the centre too."""
    path = new_path(spark, "sink-voxels")
    grid = V.voxelize(atoms(spark, sf_dir), V.VoxelParams(W, RES, "exp", "sum", SCALE), rotation=False).withColumn("density", F.round("density", 8))
    writers.voxel_pdb(grid, W, RES).select(F.col("pdb").alias("value"), "item", "channel").repartition("item", "channel").write.partitionBy("item", "channel").text(path)
    found = structures.pdb_atoms(spark, path).select(F.regexp_extract("path", r"item=(-?\d+)", 1).cast("bigint").alias("item"), F.regexp_extract("path", r"channel=(\d+)", 1).cast("int").alias("channel"), "x")
    return found.groupBy("item", "channel").agg(F.count("*").alias("atoms"), F.round(F.sum("x"), 3).alias("x"))


@query(
    "atoms_near_ligand",
    f"""WITH {ATOMS} SELECT a.vec_id FROM a WHERE num > 1 AND vec_id % 7 <> 0 AND EXISTS (SELECT 1 FROM a b WHERE b.item = a.item AND b.vec_id % 7 = 0 AND b.num > 1
AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 1)""",
)
def near_ligand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = atoms(spark, sf_dir).where("num > 1")
    return V.near_any(rows.where("vec_id % 7 <> 0"), rows.where("vec_id % 7 = 0"), 1.0).select("vec_id")
