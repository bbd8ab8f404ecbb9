"""Voxel densities of atoms on a grid, as a sparse relation.

The range join of grid points and atoms is a generator: each atom explodes into the few cells its
shape can reach, and cells are then grouped.  No point meets an atom that is out of its reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.atoms import SHAPES, density, reach, rotated


@dataclass(frozen=True)
class VoxelParams:
    """Points at (i - width / 2) * resolution, i from 0 to width - 1, along each axis."""

    width: int = 24
    resolution: float = 0.75
    shape: str = "exp"
    accumulate: str = "sum"
    scale: float = 1.75

    def __post_init__(self) -> None:
        if self.width <= 0 or self.resolution <= 0 or self.shape not in SHAPES or self.accumulate not in ("sum", "max"):
            raise ValueError(f"not valid: {self}")

    def tensor_size(self, channels: int, batch: int = 1) -> tuple[int, ...]:
        return (batch, channels, self.width, self.width, self.width)


def voxelize(atoms: DataFrame, params: VoxelParams, first_channel: int = 0, rotation: bool = False) -> DataFrame:
    """(item, channel, x, y, z, density) from atoms (item, x, y, z, mask, radius), centred on the origin.

    Bit k of mask is channel first_channel + k; atoms without a bit are invisible.  With rotation, the
    atoms' columns qw, qx, qy, qz turn the grid's points, which is the inverse turn of the atom.
    """
    w, res = params.width, params.resolution
    r = F.col("radius") * params.scale
    if rotation:
        q = (F.col("qw"), -F.col("qx"), -F.col("qy"), -F.col("qz"))
        x, y, z = rotated(q, F.col("x"), F.col("y"), F.col("z"))
        atoms = atoms.withColumns({"x": x, "y": y, "z": z})
    # A cube seen from a turned frame reaches sqrt(3) times as far.
    far = reach(params.shape, r, res) * (3**0.5 if rotation and params.shape in ("cube", "discrete") else 1.0)
    seen = atoms.where("mask <> 0").withColumn("r", r).withColumn("far", far)

    def cells(c: str):
        low = F.greatest(F.lit(0), F.ceil((F.col(c) - F.col("far")) / res + w / 2 - 1e-9).cast("int"))
        high = F.least(F.lit(w - 1), F.floor((F.col(c) + F.col("far")) / res + w / 2 + 1e-9).cast("int"))
        return F.explode(F.filter(F.sequence(F.least(low, high), F.greatest(low, high)), lambda i: (i >= low) & (i <= high)))

    keep = ["item", "mask", "x", "y", "z", "r", "far"] + (["qw", "qx", "qy", "qz"] if rotation else [])
    rows = seen.select(*keep)
    for axis, name in (("x", "ix"), ("y", "iy"), ("z", "iz")):
        rows = rows.select("*", cells(axis).alias(name))
    dx, dy, dz = (F.col(c) - (F.col(i) - w / 2) * res for c, i in (("x", "ix"), ("y", "iy"), ("z", "iz")))
    if rotation:
        dx, dy, dz = rotated((F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")), dx, dy, dz)
    rows = rows.withColumn("value", density(params.shape, dx * dx + dy * dy + dz * dz, F.col("r"), dx, dy, dz, res)).where("value is not null")
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("getbit", F.col("mask").cast("bigint"), k) == 1)
    rows = rows.select("item", F.explode(bits).alias("bit"), "ix", "iy", "iz", "value")
    total = F.sum("value") if params.accumulate == "sum" else F.max("value")
    rows = rows.groupBy("item", "bit", "ix", "iy", "iz").agg(total.alias("density"))
    return rows.select("item", (F.col("bit") + first_channel).alias("channel"), F.col("ix").alias("x"), F.col("iy").alias("y"), F.col("iz").alias("z"), "density")


def centers(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("item").agg(*[F.avg(c).alias(c) for c in "xyz"])


def near_any(atoms: DataFrame, ligand: DataFrame, distance: float) -> DataFrame:
    """The atoms (item, x, y, z) within distance of some atom of the same item's ligand: both sides fall
    into cubes of that size and only neighbouring cubes are compared."""
    cube = lambda c: F.floor(F.col(c) / distance).cast("int")
    a = atoms.withColumns({f"c{c}": cube(c) for c in "xyz"})
    b = ligand.select("item", *[F.col(c).alias("l" + c) for c in "xyz"])
    for c in "xyz":
        b = b.select("*", F.explode(F.sequence(F.floor(F.col("l" + c) / distance).cast("int") - 1, F.floor(F.col("l" + c) / distance).cast("int") + 1)).alias("c" + c))
    a = a.alias("a")
    on = (F.col("a.item") == F.col("b.item")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.cz") == F.col("b.cz"))
    d2 = sum((F.col(f"a.{c}") - F.col(f"b.l{c}")) * (F.col(f"a.{c}") - F.col(f"b.l{c}")) for c in "xyz")
    # The ligand is many times its file by now, which Spark would judge a broadcast by.
    return a.join(b.alias("b").hint("merge"), on & (d2 <= distance * distance), "left_semi").drop("cx", "cy", "cz")


def connectors(atoms: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(item, x, y, z): the given points of an item, or else the places of all its atoms (num) of number 0."""
    dummies = atoms.where("num = 0").select("item", "x", "y", "z")
    if explicit is None:
        return dummies
    return explicit.select("item", "x", "y", "z").union(dummies.join(explicit, "item", "left_anti"))


def receptor_and_parent(receptor: DataFrame, parent: DataFrame, centre: DataFrame, params: VoxelParams, parent_channel: int = 5, rotation: DataFrame | None = None) -> DataFrame:
    """The grids of items (item, channel, x, y, z, density): receptor atoms from channel 0 on, parent atoms from
    parent_channel on, both moved so that the item's centre (item, cx, cy, cz) is the origin; rotation (item, qw, qx,
    qy, qz) turns an item's grid."""

    def grid(atoms: DataFrame, first: int) -> DataFrame:
        rows = atoms.join(centre, "item").withColumns({c: F.col(c) - F.col("c" + c) for c in "xyz"})
        if rotation is not None:
            rows = rows.join(rotation, "item")
        return voxelize(rows, params, first, rotation is not None)

    return grid(receptor, 0).unionByName(grid(parent, parent_channel))


def pooled(grid: DataFrame, params: VoxelParams, operator) -> DataFrame:
    """(item, channel, value): an aggregation of the densities of all points of a channel, empty ones among them."""
    points = params.width**3
    cells = grid.groupBy("item", "channel").agg(F.collect_list("density").alias("v"))
    return cells.select("item", "channel", operator(F.concat("v", F.array_repeat(F.lit(0.0), points - F.size("v")))).alias("value"))
