"""Protein (PDB) and molecule (SDF, V2000) files as rows with typed errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import numbered, running
from .text import field, ordered_lines

# One-letter codes of the amino acids.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def pdb_atoms(spark: SparkSession, path: str, model: int = 1, whole: bool = False) -> DataFrame:
    """The ATOM and HETATM records of a model; files without MODEL records have one.

    A model's number is a running sum over parts by range, so a file of many models is many tasks; with whole, a folder's
    files are one.
    """
    rows = ordered_lines(spark, path, whole).withColumn("_model", F.col("value").startswith("MODEL ").cast("int"))
    rows = running(rows, ["path", "at"], {"_all": "_model"})
    first = rows.groupBy("path").agg((F.min("_all") - F.max_by("_model", -F.col("at"))).alias("_before"))
    rows = rows.join(first, "path").withColumn("model", F.col("_all") - F.col("_before"))
    rows = rows.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM") & F.col("model").isin(0, model))
    v = F.col("value")
    number = lambda a, b, kind: field(v, a, b).try_cast(kind)
    named = field(v, 77, 78)
    element = F.when(named != "", named).otherwise(F.regexp_extract(field(v, 13, 16), "([A-Z])", 1))
    return rows.select(
        "path", "at", field(v, 1, 6).alias("record"), number(7, 11, "int").alias("serial"), field(v, 13, 16).alias("name"), field(v, 18, 20).alias("res_name"),
        field(v, 22, 22).alias("chain"), number(23, 26, "int").alias("res_seq"), number(31, 38, "double").alias("x"), number(39, 46, "double").alias("y"), number(47, 54, "double").alias("z"),
        number(55, 60, "double").alias("occupancy"), number(61, 66, "double").alias("b_factor"), F.initcap(F.lower(element)).alias("element"),
    ).withColumn("error", F.when(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull(), "coordinates").when(F.col("element") == "", "element"))


def sequences(atoms: DataFrame) -> DataFrame:
    """path, chain and the amino-acid sequence by residue number; other residues are left out."""
    code = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    rows = atoms.select("path", "chain", "res_seq", code[F.col("res_name")].alias("letter")).where("letter is not null").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("res_seq", "letter"))), lambda x: x["letter"])
    return rows.groupBy("path", "chain").agg(F.array_join(ordered, "").alias("sequence"))


def sdf(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """path, nth, title, atoms and bonds of each record; a missing ``$$$$`` at the end is allowed.

    Bonds are numbered from 1.  A record's error is "counts" if its counts line can't be read, "atoms" or "bonds" if there
    are fewer lines of them, or one of them can't be read.  Files are cut at ``$$$$`` by blocks, so a large one is many
    tasks; with whole, a folder's files are one.
    """
    records = ordered_lines(spark, path, whole, separator="$$$$").where(F.col("value").rlike(r"\S"))
    # What is left of the line that ends a record stands before the next one.
    records = records.select("path", "at", F.split(F.when(F.col("begins"), F.col("value")).otherwise(F.regexp_replace("value", r"^\r?\n", "")), "\r?\n").alias("l"))
    records = numbered(records, ["path", "at"])
    first = records.groupBy("path").agg(F.min("nth").alias("_first"))
    whole = records.join(first, "path").select("path", (F.col("nth") - F.col("_first")).cast("int").alias("nth"), "l")
    counts = F.get("l", F.lit(3))
    n, m = field(counts, 1, 3).try_cast("int"), field(counts, 4, 6).try_cast("int")
    rows = whole.select("path", "nth", F.get("l", F.lit(0)).alias("title"), "l", n.alias("n_atoms"), m.alias("n_bonds"))
    at = F.slice("l", F.lit(5), F.greatest(F.lit(0), F.coalesce("n_atoms", F.lit(0))))
    bt = F.slice("l", F.coalesce("n_atoms", F.lit(0)) + 5, F.greatest(F.lit(0), F.coalesce("n_bonds", F.lit(0))))
    number = lambda s, a, b, kind: field(s, a, b).try_cast(kind)
    atoms = F.transform(at, lambda s, i: F.struct((i + 1).alias("idx"), field(s, 32, 34).alias("symbol"), number(s, 1, 10, "double").alias("x"), number(s, 11, 20, "double").alias("y"), number(s, 21, 30, "double").alias("z")))
    bonds = F.transform(bt, lambda s: F.struct(number(s, 1, 3, "int").alias("a"), number(s, 4, 6, "int").alias("b"), number(s, 7, 9, "int").alias("order")))
    rows = rows.select("path", "nth", "title", "n_atoms", "n_bonds", atoms.alias("atoms"), bonds.alias("bonds"))
    lacking = F.exists("atoms", lambda a: a["x"].isNull() | a["y"].isNull() | a["z"].isNull() | (a["symbol"] == ""))
    torn = F.exists("bonds", lambda b: b["a"].isNull() | b["b"].isNull() | b["order"].isNull() | ~b["a"].between(1, F.col("n_atoms")) | ~b["b"].between(1, F.col("n_atoms")))
    error = F.when(F.col("n_atoms").isNull(), "counts").when((F.size("atoms") < F.col("n_atoms")) | lacking, "atoms").when((F.size("bonds") < F.coalesce("n_bonds", F.lit(0))) | torn, "bonds")
    return rows.withColumn("error", error)


def first_readable(records: DataFrame) -> DataFrame:
    """The first record without an error of each path of sdf's; a path without one has its first record, with its error."""
    whole = F.struct(*records.columns)
    best = records.groupBy("path").agg(F.min_by(whole, F.struct(F.col("error").isNotNull(), F.col("nth"))).alias("r"))
    return best.select("r.*")
