"""Delimited and JSON sources of examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ordered_lines


@dataclass(frozen=True)
class Layout:
    """Columns (from 0; -1 the last) of a tab-separated task; test files may differ."""

    text_a: int
    text_b: int | None
    label: int | None
    guid: int | None = None
    test_a: int | None = None
    test_b: int | None = None
    header: bool = True
    test_header: bool = True
    regression: bool = False
    skip_short: bool = False


# The published layouts of the tasks.
TASKS = {
    "mrpc": Layout(3, 4, 0),
    "mnli": Layout(8, 9, -1, guid=0),
    "cola": Layout(3, None, 1, test_a=1, header=False),
    "sst-2": Layout(0, None, 1, test_a=1),
    "sts-b": Layout(7, 8, -1, guid=0, regression=True),
    "qqp": Layout(3, 4, 5, guid=0, test_a=1, test_b=2, skip_short=True),
    "qnli": Layout(1, 2, -1, guid=0),
    "rte": Layout(1, 2, -1, guid=0),
    "wnli": Layout(1, 2, -1, guid=0),
}
MNLI_LABELS = ["contradiction", "entailment", "neutral"]


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """at and cells of each line: tabs only, no quoting, without a byte-order mark.  A folder's files are one table."""
    return ordered_lines(spark, path, whole=True).select("at", F.split(F.regexp_replace("value", "^﻿", ""), "\t").alias("cells"))


def task_examples(spark: SparkSession, path: str, task: str, split: str) -> DataFrame:
    """guid, text_a, text_b, label of a task's file; test splits have no label."""
    layout = TASKS[task]
    test = split.startswith("test")
    a = layout.test_a if test and layout.test_a is not None else layout.text_a
    b = (layout.test_b if layout.test_b is not None else layout.text_b) if test else layout.text_b
    cell = lambda i: F.element_at("cells", -1) if i == -1 else F.get("cells", F.lit(i))
    rows = tsv(spark, path)
    if layout.test_header if test else layout.header:
        rows = rows.where("at > 0")
    if layout.skip_short:
        rows = rows.where(F.size("cells") > max(x for x in (a, b, None if test else layout.label) if x is not None))
    guid = F.concat(F.lit(split + "-"), F.col("at").cast("string") if layout.guid is None else cell(layout.guid))
    label = F.lit(None).cast("string") if test else cell(layout.label)
    return rows.select(guid.alias("guid"), cell(a).alias("text_a"), (cell(b) if b is not None else F.lit(None).cast("string")).alias("text_b"), label.alias("label"))


def sentence_examples(spark: SparkSession, path: str, split: str, text: int = 0, label: int = 1, guid: int | None = None, skip_first: bool = False) -> DataFrame:
    rows = tsv(spark, path)
    first = 1 if skip_first else 0
    cell = lambda i: F.get("cells", F.lit(i))
    made = F.concat(F.lit(split + "-"), (F.col("at") - first).cast("string"))
    return rows.where(F.col("at") >= first).select((cell(guid) if guid is not None else made).alias("guid"), cell(text).alias("text_a"), cell(label).alias("label"))


def xnli(spark: SparkSession, path: str, split: str, language: str) -> DataFrame:
    """train: premise, hypothesis, label; test: language first, then label and the pair in columns 6 and 7."""
    rows = tsv(spark, path).where("at > 0")
    c = lambda i: F.get("cells", F.lit(i))
    guid = F.concat(F.lit(split + "-"), F.col("at").cast("string")).alias("guid")
    fix = lambda x: F.when(x == "contradictory", "contradiction").otherwise(x).alias("label")
    if split == "train":
        return rows.select(guid, c(0).alias("text_a"), c(1).alias("text_b"), fix(c(2)))
    return rows.where(c(0) == language).select(guid, c(6).alias("text_a"), c(7).alias("text_b"), fix(c(1)))


def csv_columns(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """The CSV's columns by new names; no types are inferred."""
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in mapping.values() if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return rows.select(*[F.col(f"`{c}`").alias(n) for n, c in mapping.items()])


SQUAD = "struct<data:array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>>>>>>>>"


def squad(spark: SparkSession, path: str, training: bool) -> DataFrame:
    """qas_id, question, context, title, is_impossible; training has its first answer, others all of them."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SQUAD)["data"]).alias("d"))
    rows = rows.select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    rows = rows.select(F.col("q.id").alias("qas_id"), "q.question", "context", "title", F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"), F.col("q.answers").alias("answers"))
    if not training:
        return rows
    first = F.when(~F.col("is_impossible"), F.get("answers", F.lit(0)))
    return rows.select("qas_id", "question", "context", "title", "is_impossible", first["text"].alias("answer_text"), first["answer_start"].alias("answer_start"))


def paired_activities(spark: SparkSession, spec: str) -> DataFrame:
    """Rows of a CSV named by "path,pdb,sdf,parent,frag1,frag2,act1,act2,prevalence,dir": its columns by role."""
    parts = [p.strip() for p in spec.split(",")]
    if len(parts) != 10:
        raise ValueError("ten parts are needed")
    names = ["pdb", "sdf", "parent_smiles", "frag1", "frag2", "act1", "act2", "prevalence"]
    rows = csv_columns(spark, parts[0], {n: c for n, c in zip(names, parts[1:9], strict=True) if c})
    for n in ("act1", "act2", "prevalence"):
        if n in rows.columns:
            rows = rows.withColumn(n, F.col(n).try_cast("double"))
    return rows.withColumn("pdb", F.concat_ws("/", F.lit(parts[9]), "pdb")).withColumn("sdf", F.concat_ws("/", F.lit(parts[9]), "sdf"))


def bench(rows: DataFrame) -> DataFrame:
    """A benchmark's columns: smiles is SMILES, spaces are underscores."""
    return rows.toDF(*["SMILES" if c == "smiles" else c.replace(" ", "_") for c in rows.columns])


def single_tasks(rows: DataFrame, n_tasks: str, name: str, without: str = "PDB") -> DataFrame:
    """The rows with one task whose name doesn't hold without."""
    return rows.where(f"{n_tasks} = 1").where(~F.contains(F.col(name), F.lit(without)))


def functional_classes(spark: SparkSession, path: str) -> DataFrame:
    """smiles, functional_group and acid_base of a table of fragments: a SMILES, white space, group__class."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    rows = spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.get(parts, F.lit(0)).alias("smiles"), F.split(F.get(parts, F.lit(1)), "__", 2).alias("c"))
    return rows.select("smiles", F.get("c", F.lit(0)).alias("functional_group"), F.get("c", F.lit(1)).alias("acid_base"))


def receptor_ligand_pairs(spark: SparkSession, metadata: str, folder: str) -> DataFrame:
    """receptor, ligand and the paths of their files in a folder, from a CSV with these columns; a missing file is an error."""
    rows = csv_columns(spark, metadata, {"receptor": "receptor", "ligand": "ligand"})
    # A file's name, or that of its folder for a table that Spark has written by name.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.coalesce(F.nullif(F.regexp_extract("path", "/name=([^/]+)/[^/]+$", 1), F.lit("")), F.element_at(F.split("path", "/"), -1)).alias("name"))
    for c in ("receptor", "ligand"):
        rows = rows.join(files.select(F.col("name").alias(c), F.col("path").alias(c + "_path")), c, "left")
    return rows.select("receptor", "ligand", "receptor_path", "ligand_path", F.when(F.col("receptor_path").isNull() | F.col("ligand_path").isNull(), "file").alias("error"))


def structure_families(spark: SparkSession, metadata: str, folder: str) -> DataFrame:
    """family, pdb_id, ligand, smiles, valid and path of each structure file (pdb_id.bioN), from a CSV family,pdb_id,ligand,valid,smiles."""
    rows = csv_columns(spark, metadata, {c: c for c in ("family", "pdb_id", "ligand", "valid", "smiles")})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bio*").load(folder).select("path", F.lower(F.regexp_extract("path", r"([^/]+)\.bio\d+$", 1)).alias("_id"))
    both = rows.join(files, F.lower("pdb_id") == F.col("_id"))
    return both.select("family", "pdb_id", "ligand", (F.col("valid") == "valid").alias("valid"), "smiles", "path")


def saved_splits(spark: SparkSession, path: str) -> DataFrame:
    """split and id, from JSON of the lists of a run: {"train": [...], "val": [...], "test": [...]}."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("split", "ids"))
    return rows.select("split", F.explode("ids").alias("id"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path, made first if it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def inference_label_set(spark: SparkSession, codes: list[str], everything, path: str) -> DataFrame:
    """smiles of an inference's label set: all for everything() (kept under path), and SMI files; other codes are errors."""
    from .text import smi

    out = None
    for code in codes:
        if code == "all":
            part = cached(spark, path, everything).select("smiles")
        elif code.endswith((".smi", ".smiles")) or "/" in code:
            part = smi(spark, code).select("smiles")
        else:
            raise ValueError(f"not a label set for inference: {code}")
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no label set is named")
    return out.distinct()
