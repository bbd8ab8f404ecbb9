"""Line-oriented sources.  Lines keep their order through the file's path and their place in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.sequences import numbered, running

def lines(spark: SparkSession, path: str) -> DataFrame:
    """value of each line, stripped; blank ones stay."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value"))


def nonblank_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike(r"\S"))


def smi(spark: SparkSession, path: str) -> DataFrame:
    """smiles and name: the first two fields between white space; the name defaults to the smiles.  Blank lines are no rows."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+", 3)
    rows = spark.read.text(path).where(F.col("value").rlike(r"\S")).select(parts.alias("p"))
    return rows.select(F.get("p", F.lit(0)).alias("smiles"), F.coalesce(F.get("p", F.lit(1)), F.get("p", F.lit(0))).alias("name"))


def ordered_lines(spark: SparkSession, path: str, whole: bool = False, separator: str | None = None) -> DataFrame:
    """path, at (from 0) and value of each line, or of each part between separators.

    Files are read by blocks: a line's place is its place in its block and the lines of the file's blocks before.  With
    whole, the files of a folder are one text in the order of their paths, as Spark writes one, and path is the folder.
    Between separators, begins says whether a part is the first of its file.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), "value")
    inside = F.col("_id") - F.min("_id").over(Window.partitionBy("path", "block"))
    place = Window.orderBy("path", "block") if whole else Window.partitionBy("path").orderBy("block")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    # One row a block.
    bases = rows.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("_inside", inside).join(bases, ["path", "block"])
    begins = [] if separator is None else [((F.col("block") == 0) & (F.col("_inside") == 0)).alias("begins")]
    return rows.select(F.lit(path).alias("path") if whole else F.col("path"), (F.col("base") + F.col("_inside")).alias("at"), "value", *begins)


def blank_line_documents(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """path, doc (from 0), at, value: lines between blank lines belong to one document.  whole is as in ordered_lines.

    The blank lines so far are a running sum over parts by range, so a file may be of any size.
    """
    rows = ordered_lines(spark, path, whole).withColumn("_blank", (~F.col("value").rlike(r"\S")).cast("int"))
    rows = running(rows, ["path", "at"], {"_upto": "_blank"}).where("_blank = 0")
    docs = numbered(rows.select("path", "_upto").distinct(), ["path", "_upto"])
    first = docs.groupBy("path").agg(F.min("nth").alias("_first"))
    docs = docs.join(first, "path").select("path", "_upto", (F.col("nth") - F.col("_first")).alias("doc"))
    return rows.join(docs, ["path", "_upto"]).select("path", "doc", "at", "value")


def tagged_articles(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """path, doc, at, value of articles from a ``<doc id=`` line to ``</doc>``: without their first line
    (the title) and blank lines; an article that isn't closed is left out.  whole is as in ordered_lines.

    An article's number is a running sum over parts by range, its end and title are sums by article.
    """
    opens, closes = F.contains("value", F.lit("<doc id=")), F.contains("value", F.lit("</doc>"))
    rows = ordered_lines(spark, path, whole).select("*", opens.cast("int").alias("_open"), closes.alias("_close"))
    rows = running(rows, ["path", "at"], {"_all": "_open"})
    before = rows.groupBy("path").agg(F.min("_all").alias("_least"), F.max_by("_open", -F.col("at")).alias("_begins"))
    rows = rows.join(before, "path").withColumn("doc", F.col("_all") - F.col("_least") + F.col("_begins")).where("doc > 0")
    inside = (F.col("_open") == 0) & F.col("value").rlike(r"\S")
    ends = rows.groupBy("path", "doc").agg(F.min(F.when(F.col("_close"), F.col("at"))).alias("_end"), F.min(F.when(inside, F.col("at"))).alias("_title"))
    kept = rows.join(ends, ["path", "doc"]).where(inside & (F.col("at") < F.col("_end")) & (F.col("at") > F.col("_title")))
    return kept.select("path", (F.col("doc") - 1).alias("doc"), "at", "value")


def with_reference(spark: SparkSession, path: str, reference: str, schema: str) -> DataFrame:
    """Non-blank lines of some files, in the order of their paths, joined by place with the JSON lines of others."""
    kept = lambda at: ordered_lines(spark, at).where(F.col("value").rlike(r"\S"))
    lines, refs = (numbered(kept(at), ["path", "at"]) for at in (path, reference))
    return lines.select("nth", F.col("value").alias("line")).join(refs.select("nth", F.from_json("value", schema).alias("ref")), "nth")


def field(line: Column, start: int, stop: int) -> Column:
    """Columns start to stop of a fixed-width line, counted from 1, stripped."""
    return F.trim(F.substring(line, start, stop - start + 1))
