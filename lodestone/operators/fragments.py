"""Molecules cut at their single bonds into a parent and a fragment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.atoms import MASSES, NUMBERS
from .voxels import near_any

_SCHEMA = "bond int, parent array<int>, fragment array<int>, parent_anchor int, fragment_anchor int"


def mass(symbols: Column) -> Column:
    """Sum of the monoisotopic masses of the symbols; unknown elements weigh nothing."""
    known = F.create_map(*[F.lit(x) for pair in MASSES.items() for x in pair])
    return F.aggregate(symbols, F.lit(0.0), lambda s, x: s + F.coalesce(known[x], F.lit(0.0)))


def heavy_atoms(symbols: Column) -> Column:
    return F.size(F.filter(symbols, lambda s: s != "H"))


#: Molecules whose graphs are walked together, and parts of a mass unit that masses are summed in, so that sums are exact.
_TOGETHER, _MASS_UNITS = 512, 10**8


class _Forest:
    """Spanning trees of many graphs side by side, from the first atom of each, a level at a time.

    A tree's bond is a bridge if no other bond has one end below it: each other bond has a 64-bit number, and the
    numbers of the ends below (each twice, so nothing, if both ends are) are added up bit by bit.
    """

    def __init__(self, begins: np.ndarray, n: int, a: np.ndarray, b: np.ndarray):
        ends, other, bond = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
        order = np.argsort(ends, kind="stable")
        other, bond, first = other[order], bond[order], np.searchsorted(ends[order], np.arange(n + 1))
        self.parent, self.by, self.level = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.level[begins] = 0
        self.levels = [begins]
        while len(self.levels[-1]):
            front = self.levels[-1]
            count = first[front + 1] - first[front]
            at = np.repeat(first[front] - np.cumsum(count) + count, count) + np.arange(count.sum())
            new = self.level[other[at]] < 0
            found, which = np.unique(other[at][new], return_index=True)
            self.parent[found], self.by[found] = np.repeat(front, count)[new][which], bond[at][new][which]
            self.level[found] = len(self.levels)
            self.levels.append(found)
        in_tree = np.zeros(len(a), bool)
        in_tree[self.by[self.by >= 0]] = True
        rest = np.flatnonzero(~in_tree)
        with np.errstate(over="ignore"):
            mark = (rest.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mark = (mark ^ (mark >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mark ^= mark >> np.uint64(32)
        below, self.size = np.zeros(n, np.uint64), np.ones(n, np.int64)
        np.bitwise_xor.at(below, a[rest], mark)
        np.bitwise_xor.at(below, b[rest], mark)
        for v in self.levels[:0:-1]:
            np.bitwise_xor.at(below, self.parent[v], below[v])
            np.add.at(self.size, self.parent[v], self.size[v])
        self.bridges = np.flatnonzero((self.parent >= 0) & (below == 0))
        # Places in an order in which all that is below an atom follows it.
        self.place = np.full(n, -1)
        self.place[begins] = begins
        for v in self.levels[1:]:
            v = v[np.argsort(self.parent[v], kind="stable")]
            before = np.cumsum(self.size[v]) - self.size[v]
            head = np.searchsorted(self.parent[v], self.parent[v], "left")
            self.place[v] = self.place[self.parent[v]] + 1 + before - before[head]


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32), pa.array(values.astype(np.int32)))


def _pieces(part: pa.RecordBatch, only_single: bool, most: float) -> pa.RecordBatch:
    atoms, bonds = part.column(1), part.column(2)
    n_atoms, n_bonds = (pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64) for c in (atoms, bonds))
    begins = np.cumsum(n_atoms) - n_atoms
    symbols = atoms.flatten().field("symbol").to_pylist()
    mass = np.array([round(MASSES.get(x, 0.0) * _MASS_UNITS) for x in symbols], np.int64)
    heavy = np.array([NUMBERS.get(x, 0) > 1 for x in symbols], np.int64)
    flat = bonds.flatten()
    a, b, kind = (pc.fill_null(flat.field(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "order"))
    of = np.repeat(np.arange(part.num_rows), n_bonds)
    number = np.arange(len(a)) - np.repeat(np.cumsum(n_bonds) - n_bonds, n_bonds)
    # A bond without its atoms, or of an atom with itself, joins nothing.
    good = (a >= 1) & (b >= 1) & (a <= n_atoms[of]) & (b <= n_atoms[of]) & (a != b)
    a, b, kind, of, number = begins[of[good]] + a[good] - 1, begins[of[good]] + b[good] - 1, kind[good], of[good], number[good]
    n = len(symbols)
    tree = _Forest(begins[n_atoms > 0], n, a, b)
    whole = np.bincount(np.repeat(np.arange(part.num_rows), n_atoms), tree.level < 0, part.num_rows) == 0
    v = tree.bridges
    v = v[whole[of[tree.by[v]]] & ((kind[tree.by[v]] == 1) | (not only_single))]
    bond = tree.by[v]
    v, bond = (x[np.argsort(bond, kind="stable")] for x in (v, bond))
    mol = of[bond]
    along = np.zeros(n, np.int64)
    along[tree.place[tree.place >= 0]] = np.flatnonzero(tree.place >= 0)

    def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below the bridge, and on its other side."""
        upto = np.concatenate([[0], np.cumsum(x[along])])
        low = upto[tree.place[v] + tree.size[v]] - upto[tree.place[v]]
        return low, upto[begins[mol] + n_atoms[mol]] - upto[begins[mol]] - low

    (mass_low, mass_rest), (heavy_low, heavy_rest) = sums(mass), sums(heavy)
    a_is_low = a[bond] == v
    # The side of a bond's first atom is the parent if it isn't lighter.
    cut_low = np.where(a_is_low, mass_low < mass_rest, mass_low <= mass_rest)
    weight, held = np.where(cut_low, mass_low, mass_rest), np.where(cut_low, heavy_low, heavy_rest)
    kept = (held > 0) & ((weight / _MASS_UNITS <= most) | (most < 0))
    v, bond, mol, cut_low = v[kept], bond[kept], mol[kept], cut_low[kept]
    rows = np.repeat(np.arange(len(v)), n_atoms[mol])
    atom = np.arange(len(rows)) - np.repeat(np.cumsum(n_atoms[mol]) - n_atoms[mol], n_atoms[mol])
    place = tree.place[begins[mol][rows] + atom]
    low = (place >= tree.place[v][rows]) & (place < (tree.place[v] + tree.size[v])[rows])
    cut = low == cut_low[rows]
    up = tree.parent[v]
    anchors = [np.where(cut_low, up, v) - begins[mol] + 1, np.where(cut_low, v, up) - begins[mol] + 1]
    return pa.RecordBatch.from_arrays(
        [part.column(0).take(pa.array(mol)), pa.array(number[bond].astype(np.int32)), _lists(atom[~cut] + 1, rows[~cut], len(v)), _lists(atom[cut] + 1, rows[cut], len(v)), *(pa.array(x.astype(np.int32)) for x in anchors)],
        [part.schema.names[0], "bond", "parent", "fragment", "parent_anchor", "fragment_anchor"],
    )


def _cuts(only_single: bool, most: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _TOGETHER):
                yield _pieces(batch.slice(i, _TOGETHER), only_single, most)

    return rows


def split_bonds(mols: DataFrame, key: str, only_single: bool = True, most_mass: float = -1) -> DataFrame:
    """key, bond (from 0), parent and fragment (atoms from 1) and the atoms that the bond joined.

    mols has key, atoms and bonds arrays (as the SDF source gives them).  A bond is cut where that
    gives exactly two pieces; the lighter one is the fragment, which needs a heavy atom and, unless
    most_mass is below 0, may weigh that at most.  A molecule is one row, so the graph walk is local; the graphs of
    many are walked together.
    """
    kind = mols.schema[key].dataType.simpleString()
    return mols.select(key, "atoms", "bonds").mapInArrow(_cuts(only_single, most_mass), f"{key} {kind}, {_SCHEMA}")


@dataclass(frozen=True)
class Bounds:
    """What a fragment must be like: its mass, its heavy atoms, how near one of its atoms is to the receptor (None: anywhere)
    and how often one of its kind is taken (None: always)."""

    least_mass: float = 0.0
    most_mass: float = 150.0
    least_heavy: int = 1
    most_heavy: int = 9999
    most_distance: float | None = 4.0
    repeats: int | None = None


def fragments(mols: DataFrame, key: str, bounds: Bounds, receptor: DataFrame | None = None, kind: str | None = None, only_single: bool = True) -> DataFrame:
    """split_bonds' rows within bounds, with mass, heavy and formula (the fragment's elements, sorted, with their numbers).

    receptor has key, x, y and z of the atoms that a molecule's fragments are to be near to.  Of the fragments of a kind
    (a column of the result; formula by default), the first by key and bond are taken.
    """
    split = split_bonds(mols, key, only_single).join(mols.select(key, "atoms").hint("merge"), key)
    own = F.transform("fragment", lambda i: F.get("atoms", i - 1))
    split = split.withColumn("own", own).withColumn("symbols", F.array_sort(F.transform("own", lambda a: a["symbol"])))
    counted = F.transform(F.array_distinct("symbols"), lambda e: F.concat(e, F.size(F.filter("symbols", lambda x: x == e)).cast("string")))
    split = split.select("*", mass(F.col("symbols")).alias("mass"), F.size(F.filter("symbols", lambda x: x != "H")).alias("heavy"), F.array_join(counted, "").alias("formula"))
    found = split.where(F.col("mass").between(bounds.least_mass, bounds.most_mass) & F.col("heavy").between(bounds.least_heavy, bounds.most_heavy))
    if receptor is not None and bounds.most_distance is not None:
        atoms = found.select(F.col(key).alias("item"), "bond", F.inline("own")).select("item", "bond", "x", "y", "z")
        near = near_any(atoms, receptor.select(F.col(key).alias("item"), "x", "y", "z"), bounds.most_distance).select(F.col("item").alias(key), "bond").distinct()
        found = found.join(near, [key, "bond"], "left_semi")
    if bounds.repeats is not None:
        # Only the first few of a kind in each part are shuffled.
        found = found.withColumn("_nth", F.row_number().over(Window.partitionBy(kind or "formula").orderBy(key, "bond"))).where(F.col("_nth") <= bounds.repeats).drop("_nth")
    return found.drop("own", "symbols", "atoms")
