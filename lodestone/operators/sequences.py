"""Runs, batches and streams of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import written


def runs(rows: DataFrame, keys: list[str], order: str, value: str, starts: Column | None = None) -> DataFrame:
    """rows with run, numbered from 1 within keys: adjacent rows with the same value; starts begins one too."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~F.lag(value).over(w).eqNullSafe(F.col(value))
    if starts is not None:
        new = new | starts
    return rows.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def entity_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, entity, score and word of the entities in rows (keys, index, entity, score, word, is_subword).

    A token goes on with the group before it if it is next to it, of the same type (behind the mark) and not marked B;
    a subword always does, has its type and doesn't count in the mean score.  Pieces (``##``) are put together.
    """
    order = Window.partitionBy(*keys).orderBy("index")
    first = F.row_number().over(order) == 1
    inner = F.col("is_subword") & ~first
    kind = F.element_at(F.split("entity", "-"), -1)
    rows = rows.withColumn("_inner", inner).withColumn("_type", F.when(~F.col("_inner"), kind))
    rows = rows.withColumn("_type", F.last("_type", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    goes_on = (F.lag("_type").over(order) == F.col("_type")) & (F.get(F.split("entity", "-"), F.lit(0)) != "B") & (F.lag("index").over(order) == F.col("index") - 1)
    rows = rows.withColumn("_new", F.when(F.col("_inner") | F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("index", "word"))), lambda x: x["word"])
    word = F.trim(F.replace(F.array_join(words, " "), F.lit(" ##"), F.lit("")))
    grouped = rows.groupBy(*keys, "_group").agg(F.min("index").alias("start"), F.min_by("_type", "index").alias("entity"), F.avg(F.when(~F.col("_inner"), F.col("score"))).alias("score"), word.alias("word"))
    return grouped.drop("_group")


def numbered(rows: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """rows numbered from 0 in a total order, without one task for all: rows are dealt out by range of
    the order and sorted within their part, and that one partitioning is written; so the counts are those
    of the very parts in which the rows stand."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    # The upper bits of such an id are the part's number, the lower 33 the row's place in it.
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # One row a partition.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + at).drop("_part", "_at", "_base")


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with running sums over a total order, the row's own value included: sums maps a new name to the
    column summed.  As in numbered, parts by range are written once; a part's sum starts from those before."""
    placed = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums])
    out = placed.join(F.broadcast(bases), "_part")
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_base_{n}") + F.sum(c).over(inside))
    return out.drop("_part", *[f"_base_{n}" for n in sums])


def batched(rows: DataFrame, nth: str, size: int, value: str) -> DataFrame:
    """batch, values: full batches of size rows by number, the last as it is."""
    g = rows.groupBy(F.floor(F.col(nth) / size).alias("batch"))
    return g.agg(F.transform(F.array_sort(F.collect_list(F.struct(nth, value))), lambda x: x[value]).alias("values"))


def valid_batches(rows: DataFrame, order: list[str], valid: str, size: int, batches: int) -> DataFrame:
    """(batch, at, ...): the valid rows in order, again and again, until there are so many full batches."""
    kept = numbered(rows.where(valid), order)
    n = kept.count()
    if n == 0:
        return kept.select(F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("at"), "*").drop("nth").limit(0)
    turns = -(-size * batches // n)
    again = kept.withColumn("nth", F.explode(F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda t: F.col("nth") + t * n))).where(F.col("nth") < size * batches)
    return again.select(F.floor(F.col("nth") / size).alias("batch"), (F.col("nth") % size).alias("at"), *[c for c in again.columns if c != "nth"])


def gathered(parts: list[DataFrame], order: list[str], value: str, n: int, pad: int = -100) -> DataFrame:
    """The first n rows, in order, of all parts together, with arrays filled up to the widest of all parts."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    width = rows.agg(F.max(F.size(value)).alias("_width"))  # one row
    kept = rows.orderBy(*order).limit(n).crossJoin(F.broadcast(width))
    return kept.withColumn(value, F.concat(value, F.array_repeat(F.lit(pad), F.col("_width") - F.size(value)))).drop("_width")
