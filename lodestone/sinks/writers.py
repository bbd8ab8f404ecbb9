"""Writers; all write folders by Spark's own committers."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_k_tsv(matches: DataFrame, path: str, smiles: str = "smiles", similarity: str = "similarity") -> None:
    rows = matches.select(F.col(smiles).alias("SMILES"), F.format_string("%.3f", F.col(similarity)).alias("Score (Cosine Similarity)"))
    rows.write.option("sep", "\t").option("header", True).csv(path)


def results_json(results: DataFrame, path: str) -> None:
    """Nested results by rows; "Receptor " before a receptor's name goes."""
    if "receptor" in results.columns:
        results = results.withColumn("receptor", F.regexp_replace("receptor", "^Receptor ", ""))
    results.write.json(path)


def once(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Written only if nothing is there yet."""
    rows.write.mode("ignore").format(kind).save(path)


def examples_used(rows: DataFrame) -> DataFrame:
    """split and a map from each receptor to the list of its fragments, repeats kept."""
    lists = rows.groupBy("split", "receptor").agg(F.array_sort(F.collect_list("fragment")).alias("fragments"))
    return lists.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("receptor", "fragments")))).alias("used"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def table(rows: DataFrame, path: str, kind: str, overwrite: bool = False) -> None:
    """csv (with header), json, parquet or text; refuses to write over anything unless told to."""
    writer = rows.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def benchmark_csv(results: DataFrame, path: str) -> None:
    """model, batch_size, sequence_length and result to four places."""
    results.select("model", "batch_size", "sequence_length", F.format_string("%.4f", F.col("result")).alias("result")).write.option("header", True).csv(path)


def molblock(mols: DataFrame, key: str) -> DataFrame:
    """key and the V2000 text of atoms and bonds arrays (as the SDF source gives them)."""
    atom = F.transform("atoms", lambda a: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0", a["x"], a["y"], a["z"], a["symbol"]))
    bond = F.transform("bonds", lambda b: F.format_string("%3d%3d%3d  0", b["a"], b["b"], b["order"]))
    head = F.array(F.coalesce("title", F.lit("")), F.lit(""), F.lit(""), F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size("atoms"), F.size("bonds")))
    return mols.select(key, F.array_join(F.concat(head, atom, bond, F.array(F.lit("M  END"))), "\n").alias("molblock"))


def pdb_text(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """keys and HETATM lines of atoms (serial, name, element, x, y, z) in order."""
    line = F.format_string("HETATM%5d %-4s LIG A   1    %8.3f%8.3f%8.3f  1.00  0.00          %2s", "serial", "name", "x", "y", "z", "element")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("serial", line.alias("line")))), lambda x: x["line"])
    return atoms.groupBy(*keys).agg(F.array_join(ordered, "\n").alias("pdb"))


def voxel_pdb(grid: DataFrame, width: int, resolution: float, above: float = 0.5) -> DataFrame:
    """item, channel and one dummy atom for each cell over above, and always one at the centre."""
    cells = grid.where(F.col("density") > above).select("item", "channel", *[((F.col(c) - width / 2) * resolution).alias(c) for c in "xyz"])
    centre = grid.select("item", "channel").distinct().select("item", "channel", *[F.lit(0.0).alias(c) for c in "xyz"])
    rows = centre.withColumn("o", F.lit(0)).union(cells.withColumn("o", F.lit(1)))
    rows = rows.withColumn("serial", F.row_number().over(Window.partitionBy("item", "channel").orderBy("o", "x", "y", "z"))).withColumn("name", F.lit("X")).withColumn("element", F.lit("X"))
    return pdb_text(rows, ["item", "channel"])


def numbered_results(results: DataFrame, folder: str, name: str = "test_results") -> str:
    """Written as JSON under the first name-1, name-2, ... that isn't there yet; returns the path."""
    spark = results.sparkSession
    n = 1
    while True:
        path = f"{folder}/{name}-{n}"
        try:
            spark.read.text(path)
        except AnalysisException:
            results_json(results, path)
            return path
        n += 1


def predictions_json(predictions: DataFrame, key: str, path: str) -> None:
    """A line of JSON with one field, the answer by its question, for each row (key, text)."""
    predictions.select(F.to_json(F.create_map(F.col(key).cast("string"), "text")).alias("value")).write.text(path)


def n_best_json(n_best: DataFrame, key: str, path: str) -> None:
    """A line of JSON for each question: its answers (place, text, probability, score) in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text", "probability", "score"))), lambda x: F.struct(x["text"].alias("text"), x["probability"].alias("probability"), x["score"].alias("score")))
    rows = n_best.groupBy(key).agg(listed.alias("answers"))
    rows.select(F.to_json(F.create_map(F.col(key).cast("string"), "answers")).alias("value")).write.text(path)


def parameters_json(spark, parameters: dict, path: str) -> None:
    """The parameters of a run, as one line of JSON by sorted names."""
    spark.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def run_blob(matches: DataFrame, rotations: DataFrame, average: DataFrame, path: str) -> None:
    """What an inference run found, as three tables under a folder."""
    for name, rows in (("most_similar", matches), ("fps_per_rot", rotations), ("fps_avg", average)):
        rows.write.parquet(f"{path}/{name}")


def graph_molblock(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key and V2000 text of an abstract graph: a carbon for each node (key, node from 0, x, y, z), a single bond for
    each edge (key, a, b)."""
    atoms = nodes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "x", "y", "z"))), lambda n: F.struct((n["node"] + 1).cast("int").alias("idx"), F.lit("C").alias("symbol"), n["x"].alias("x"), n["y"].alias("y"), n["z"].alias("z"))).alias("atoms"))
    bonds = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col("a") + 1).cast("int").alias("a"), (F.col("b") + 1).cast("int").alias("b"), F.lit(1).alias("order")))).alias("bonds"))
    empty = F.array().cast("array<struct<a:int,b:int,order:int>>")
    both = atoms.join(bonds, key, "left").select(key, F.lit("").alias("title"), "atoms", F.coalesce("bonds", empty).alias("bonds"))
    return molblock(both, key)
