"""SMILES graphs, clusters, merges and the inner-product index against golden values and plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import smiles_graph as G
from lodestone.functions.atoms import MASSES
from lodestone.operators import clusters, fragments, inner_products, merges

# error, atoms, bonds, hydrogens, parts and the orders of the bonds, by hand.
GOLDEN = {
    "C": (None, 1, 0, 4, 1, []),
    "CC(=O)O": (None, 4, 3, 4, 1, [1, 2, 1]),
    "c1ccccc1": (None, 6, 6, 6, 1, [1.5] * 6),
    "c1ccc2ccccc2c1": (None, 10, 11, 8, 1, [1.5] * 11),
    "c1cc[nH]c1": (None, 5, 5, 5, 1, [1.5] * 5),
    "O=c1cc[nH]cc1": (None, 7, 7, 5, 1, [2] + [1.5] * 6),
    "[O-][n+]1ccccc1": (None, 7, 7, 5, 1, [1] + [1.5] * 6),
    "C/C=C\\C": (None, 4, 3, 8, 1, [1, 2, 1]),
    "[Na+].[Cl-]": (None, 2, 0, 0, 2, []),
    "C%12CC%12": (None, 3, 3, 6, 1, [1, 1, 1]),
    "C=1CC=1": (None, 3, 3, 4, 1, [1, 1, 2]),
    "C12CC1C2": (None, 4, 5, 6, 1, [1] * 5),
    "N#N": (None, 2, 1, 0, 1, [3]),
    "OS(=O)(=O)O": (None, 5, 4, 2, 1, [1, 2, 2, 1]),
    "CN(=O)=O": (None, 4, 3, 3, 1, [1, 2, 2]),
    "[C@@H](N)(C)C(=O)O": (None, 6, 5, 7, 1, [1, 1, 1, 2, 1]),
    "[13CH4:7]": (None, 1, 0, 4, 1, []),
    "  ClC(Br)I\n": (None, 4, 3, 1, 1, [1, 1, 1]),
    "": ("empty",),
    " \t": ("empty",),
    "CX": ("token",),
    "C C": ("token",),
    "[Xx]": ("bracket",),
    "[C": ("bracket",),
    "[]": ("bracket",),
    "C(": ("branch",),
    "C)": ("branch",),
    "C()C": ("branch",),
    "(C)": ("branch",),
    "C((C))": ("branch",),
    "C1CC": ("ring",),
    "C11": ("ring",),
    "C12CC12": ("ring",),
    "C=1CC-1": ("ring",),
    "1CC1": ("ring",),
    "C=": ("bond",),
    "=C": ("bond",),
    "C==C": ("bond",),
    "C.": ("bond",),
    "C(=)C": ("bond",),
    "C(C)(C)(C)(C)C": ("valence",),
    "FCF(C)": ("valence",),
}


def test_smiles_graphs(spark):
    rows = spark.createDataFrame([(t,) for t in GOLDEN], "s string").select("s", G.graph(F.col("s")).alias("g"), G.is_valid(F.col("s")).alias("valid"))
    got = rows.select("s", "valid", "g.*", G.hydrogens(F.col("g.atoms")).alias("h"), G.components(F.col("g.atoms"), F.col("g.bonds")).alias("parts")).collect()
    for r in got:
        want = GOLDEN[r.s]
        if len(want) == 1:
            assert (r.error, r.valid, r.atoms, r.bonds) == (*want, False, [], []), r.s
        else:
            assert (r.error, len(r.atoms), len(r.bonds), r.h, r.parts, [b.order for b in r.bonds]) == want and r.valid, r.s
    by = {r.s: r for r in got}
    assert [(a.symbol, a.aromatic, a.charge) for a in by["[O-][n+]1ccccc1"].atoms][:3] == [("O", False, -1), ("N", True, 1), ("C", True, 0)]
    assert by["[13CH4:7]"].atoms[0].isotope == 13 and [(b.a, b.b) for b in by["C12CC1C2"].bonds] == [(1, 2), (2, 3), (1, 3), (3, 4), (1, 4)]
    none = spark.createDataFrame([(None,)], "s string").select(G.graph(F.col("s")).alias("g"), G.is_valid(F.col("s")).alias("v")).first()
    assert none.g is None and none.v is False


def test_long_texts_take_time_in_proportion(spark):
    n = 20_000
    texts = ["C" * n, "C1" + "C" * n + "C1", "C(" * n + "C" + ")" * n]
    started = time.monotonic()
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(G.graph(F.col("s")).alias("g")).select("g.*")
    got = rows.select(F.size("atoms"), F.size("bonds"), G.hydrogens(F.col("atoms")), G.components(F.col("atoms"), F.col("bonds"))).collect()
    assert sorted(map(tuple, got)) == [(n, n - 1, 2 * n + 2, 1), (n + 1, n, 2 * n + 4, 1), (n + 2, n + 2, 2 * n + 4, 1)]
    assert time.monotonic() - started < 60


def test_masses_have_implicit_hydrogens(spark):
    # Monoisotopic masses as published.
    known = {"CC(=O)Oc1ccccc1C(=O)O": 180.04225873, "Cn1cnc2c1c(=O)n(C)c(=O)n2C": 194.08037556, "CC(C)Cc1ccc(cc1)C(C)C(=O)O": 206.13067982, "[2H]O[2H]": 20.0231181752, "[13CH4]": 17.03465496}
    rows = spark.createDataFrame([(t,) for t in known], "s string").select("s", G.exact_mass(G.graph(F.col("s"))["atoms"]).alias("m"))
    assert all(abs(r.m - known[r.s]) < 1e-5 for r in rows.collect())


def plain_butina(sets, cutoff):
    ids = sorted(sets)
    def near(a, b):  # noqa: E306
        both = len(sets[a] & sets[b])
        either = len(sets[a]) + len(sets[b]) - both
        return 1 - (both / either if either else 1.0) <= cutoff
    others = {a: [b for b in ids if b != a and near(a, b)] for a in ids}
    centre = {}
    for a in sorted(ids, key=lambda a: (-len(others[a]), a)):
        if a not in centre:
            centre[a] = a
            for b in others[a]:
                centre.setdefault(b, a)
    return {a: (centre[a], len(others[a])) for a in ids}


def test_butina(spark):
    rng = random.Random(6)
    seeds = [frozenset(rng.sample(range(256), rng.randint(10, 40))) for _ in range(90)]
    sets = {}
    for i in rng.sample(range(9000), 2000):
        bits = set(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            bits ^= {rng.randrange(256)}
        sets[i] = frozenset(bits) if rng.random() > 0.01 else frozenset()
    frame = spark.createDataFrame([(i, sorted(b)) for i, b in sets.items()], "id long, bits array<int>").repartition(3)
    for cutoff in (0.0, 0.25, 0.5):
        got = {r.id: (r.centre, r.neighbours) for r in clusters.butina(frame, cutoff).collect()}
        assert got == plain_butina(sets, cutoff)
    with pytest.raises(ValueError, match="cutoff"):
        clusters.butina(frame, 1.0)
    assert clusters.butina(frame.limit(0), 0.3).count() == 0


def plain_merges(symbols, ranks):
    symbols = list(symbols)
    while True:
        best = min((ranks[p], p) for p in [*zip(symbols, symbols[1:]), None] if p in ranks) if any(p in ranks for p in zip(symbols, symbols[1:])) else None
        if best is None:
            return symbols
        out, i = [], 0
        while i < len(symbols):
            if tuple(symbols[i : i + 2]) == best[1]:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


def test_merges(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("aabé 字\x00") for _ in range(rng.randint(0, 14))) for _ in range(400)} | {"", "a" * 9, "a" * 50})
    letters = merges.byte_letters()
    assert len(set(letters)) == 256 and letters[32] == "Ġ" and letters[10] == "Ċ" and letters[ord("a")] == "a"
    split = {w: [letters[b] for b in w.encode()] for w in words}
    pairs, pool = [], sorted({s for x in split.values() for s in x})
    while len(pairs) < 60:
        p = (rng.choice(pool), rng.choice(pool))
        if p not in pairs:
            pairs.append(p)
            pool.append(p[0] + p[1])
    ranks = {p: i for i, p in enumerate(pairs)}
    table = spark.createDataFrame([(i, a, b) for (a, b), i in ranks.items()], "rank int, left string, right string")
    frame = spark.createDataFrame([(w,) for w in words], "word string").select("word", merges.byte_symbols(F.col("word")).alias("symbols")).repartition(3)
    assert {r.word: r.symbols for r in frame.collect()} == split
    got = {r.word: r for r in merges.merged(frame, table).withColumn("again", merges.from_byte_symbols(F.col("symbols"))).collect()}
    assert {w: r.symbols for w, r in got.items()} == {w: plain_merges(s, ranks) for w, s in split.items()}
    assert all(r.again == w for w, r in got.items()) and any(len(r.symbols) < len(split[w]) - 3 for w, r in got.items())


def test_inner_product_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] * rng.uniform(0.5, 2, (3000, 1)) + rng.normal(size=(3000, 16)) * 0.3
    x[100] = x[7]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [float("nan")] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    monkeypatch.setattr(inner_products, "BLOCK_ROWS", 100)
    monkeypatch.setattr(inner_products, "BLOCK_QUERIES", 20)
    index = inner_products.build(frame, 10)
    queries = frame.where("id % 20 = 0")
    ids = np.arange(0, 3000, 20)
    products = np.round(x[ids] @ x.T, 9)
    want = {int(q): sorted(range(3000), key=lambda i: (-products[n, i], i))[:10] for n, q in enumerate(ids)}
    exact, near = {}, {}
    for out, flag in ((exact, True), (near, False)):
        for r in inner_products.search(index, queries, 10, exact=flag).collect():
            out.setdefault(r.query_id, {})[r.rank] = r.id
    assert {q: [r[i] for i in sorted(r)] for q, r in exact.items()} == want
    assert np.mean([len(set(near[q].values()) & set(w)) / 10 for q, w in want.items()]) > 0.9
    assert inner_products.rows_read(index, queries) < 0.35
    few = frame.where("id < 3")
    assert inner_products.search(inner_products.build(few, 5), queries.where("id = 20"), 5).count() == 3


def plain_cuts(symbols, bonds, most):
    """Each single bond without which exactly two pieces are left, by a walk for each."""
    n, out = len(symbols), []

    def reached(start, without):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for i, (a, b, _) in enumerate(bonds):
                if i != without and x in (a, b) and (y := b if x == a else a) not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    if not n or len(reached(1, None)) < n:
        return out
    weigh = lambda side: sum(round(MASSES.get(symbols[x - 1], 0) * 10**8) for x in side)
    for i, (a, b, order) in enumerate(bonds):
        mine = reached(a, i)
        if order != 1 or a == b or b in mine:
            continue
        rest = set(range(1, n + 1)) - mine
        parent, fragment, ends = (mine, rest, (a, b)) if weigh(mine) >= weigh(rest) else (rest, mine, (b, a))
        if any(symbols[x - 1] in ("C", "N", "O") for x in fragment) and not 0 <= most < weigh(fragment) / 10**8:
            out.append((i, sorted(parent), sorted(fragment), *ends))
    return out


def test_fragments_of_random_graphs(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        n = rng.choice([0, 1, 2, 5, 9, 14])
        bonds = [(rng.randint(max(1, i - 3), i), i + 1, rng.choice([1, 1, 1, 2])) for i in range(1, n) if rng.random() > 0.02]
        bonds += [(rng.randint(1, n), rng.randint(1, n), 1) for _ in range(rng.choice([0, 0, 1, 2])) if n]
        rng.shuffle(bonds)
        rows.append((k, [(i + 1, rng.choice(["C", "C", "N", "O", "H", "Xx"]), float(i), 0.0, 0.0) for i in range(n)], bonds))
    schema = "k long, atoms array<struct<idx:int,symbol:string,x:double,y:double,z:double>>, bonds array<struct<a:int,b:int,order:int>>"
    frame = spark.createDataFrame([*rows, (900, None, None)], schema).repartition(3)
    monkeypatch.setattr(fragments, "_TOGETHER", 17)
    for most in (-1, 30):
        got = {}
        for r in fragments.split_bonds(frame, "k", most_mass=most).collect():
            got.setdefault(r.k, []).append((r.bond, r.parent, r.fragment, r.parent_anchor, r.fragment_anchor))
        want = {k: found for k, atoms, bonds in rows if (found := plain_cuts([a[1] for a in atoms], bonds, most))}
        assert {k: sorted(v) for k, v in got.items()} == want
    assert len(want) > 100


def test_fragments_within_bounds(spark):
    chain = [(i + 1, s, 1.5 * i, 0.0, 0.0) for i, s in enumerate("CCCCNO")]
    mols = spark.createDataFrame([(k, chain, [(i, i + 1, 1) for i in range(1, 6)]) for k in (1, 2, 3)], "k long, atoms array<struct<idx:int,symbol:string,x:double,y:double,z:double>>, bonds array<struct<a:int,b:int,order:int>>")
    receptor = spark.createDataFrame([(1, 0.0, 3.0, 0.0), (2, 7.5, 3.0, 0.0)], "k long, x double, y double, z double")
    of = lambda **b: sorted((r.k, r.bond, r.formula) for r in fragments.fragments(mols, "k", fragments.Bounds(**b), receptor).collect())
    every = [(0, "C1"), (1, "C2"), (2, "C3"), (3, "N1O1"), (4, "O1")]
    assert of(most_distance=None) == [(k, b, f) for k in (1, 2, 3) for b, f in every]
    # Near the first atom, or near the last; the third has no receptor.
    assert of(most_distance=3.2) == [(1, 0, "C1"), (1, 1, "C2"), (1, 2, "C3"), (2, 3, "N1O1"), (2, 4, "O1")]
    assert of(most_distance=None, least_mass=13, most_mass=25, most_heavy=2) == [(k, b, f) for k in (1, 2, 3) for b, f in every if f in ("C2", "O1")]
    assert of(most_distance=None, repeats=2) == [(k, b, f) for k in (1, 2) for b, f in every]
