"""The whole of batch retrieval: predictions averaged, looked up in a label set, scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval
from ..storage import written


def label_codes(codes: str) -> list[str]:
    """train, val, test, all or paths, by commas; all stands for the three splits."""
    out: list[str] = []
    for code in (c.strip() for c in codes.split(",") if c.strip()):
        out += ["train", "val", "test"] if code == "all" else [code]
    if not out:
        raise ValueError("no label set is named")
    return list(dict.fromkeys(out))


def evaluated(predictions: DataFrame, library: DataFrame, k: int, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches and accuracies for predictions (entry, checkpoint, rotation, vector, target).

    Rotations are averaged within a checkpoint, then checkpoints; library has (id, vector).
    """
    per_checkpoint = retrieval.mean_vector(predictions, ["entry", "checkpoint"], "vector")
    mean = retrieval.mean_vector(per_checkpoint, ["entry"], "vector")
    targets = predictions.groupBy("entry").agg(F.first("target").alias("target"))
    # Both look-ups read it several times.
    queries = written(mean.select(F.col("entry").alias("id"), "vector"), "evaluation-queries")
    matches = retrieval.top_k(queries, library, k, digits=digits)
    ranks = retrieval.target_ranks(queries.join(targets.withColumnRenamed("entry", "id"), "id"), library)
    return matches, retrieval.top_k_accuracy(ranks, list(range(1, k + 1)))
