"""Connected components by repeated hooking to the smallest neighbour, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the same for all of a component.

    Each round hooks every node to its smallest neighbour, follows that pointer once more, and
    contracts the edges.  Every node that still has an edge either is hooked or receives a hook, so
    the nodes at least halve in a round.  No component meets in one task: the smallest neighbour is
    a map-side combined minimum, and the joins are on nodes, split by AQE where they are skewed.
    Null ends and self-loops are dropped.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = written(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), name)
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), name)
        far = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = written(hook.join(far, "to").select(F.col("a").alias("node"), F.col("next").alias("root")), name)
        if roots is None:
            roots = step
        else:
            then = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root")), name)
        a, b = (step.select(F.col("node").alias(x), F.col("root").alias("to_" + x)) for x in "ab")
        edges = written(edges.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), name)
    return roots if roots is not None else edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
