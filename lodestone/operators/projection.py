"""Principal components of a label set."""

from __future__ import annotations

from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm


def centred(library: DataFrame, components: list[list[float]]):
    """Projects (id, vector) frames onto given components after scaling to length 1, and subtracts the library's mean."""
    matrix = [F.array(*map(F.lit, c)) for c in components]

    def placed(rows: DataFrame) -> DataFrame:
        length = F.greatest(norm(F.col("vector")), F.lit(1e-300))
        return rows.select("id", F.array(*[dot(F.col("vector"), c) / length for c in matrix]).alias("c"))

    centre = placed(library).agg(*[F.avg(F.get("c", F.lit(i))) for i in range(len(components))]).first()

    def project(rows: DataFrame) -> DataFrame:
        return placed(rows).select("id", F.array(*[F.get("c", F.lit(i)) - F.lit(m) for i, m in enumerate(centre)]).alias("components"))

    return project


def fitted(library: DataFrame, k: int):
    """Projects (id, vector) frames onto the first k components of the normalised library, which are centred on it.

    Returns the function and the percentage of variance each component explains.
    """
    normal = Normalizer(inputCol="v", outputCol="u")
    unit = lambda rows: normal.transform(rows.withColumn("v", array_to_vector("vector")))
    model = PCA(k=k, inputCol="u", outputCol="c").fit(unit(library))
    centre = model.transform(unit(library)).select(vector_to_array("c").alias("c")).agg(*[F.avg(F.get("c", F.lit(i))) for i in range(k)]).first()

    def project(rows: DataFrame) -> DataFrame:
        placed = model.transform(unit(rows)).withColumn("c", vector_to_array("c"))
        return placed.select("id", F.array(*[F.get("c", F.lit(i)) - F.lit(centre[i]) for i in range(k)]).alias("components"))

    return project, [100 * float(x) for x in model.explainedVariance]
