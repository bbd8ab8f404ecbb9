"""Rows that a function fails on go to a table of their own, with the reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

_REASON, _VALUE = "reason", "value"


def _attempts(f: Callable[[pd.DataFrame], pd.Series], names: list[str]):
    def attempt(part: pd.DataFrame, at: int, values: list, reasons: list) -> None:
        """Values of the rows from at or, the part halved until it is a row, the reason of the failure."""
        try:
            found = list(f(part))
            if len(found) != len(part):
                raise ValueError(f"{len(found)} values for {len(part)} rows")
            values[at : at + len(part)] = found
        except Exception as e:  # noqa: BLE001  whatever it is, it is the row's reason
            if len(part) == 1:
                reasons[at] = f"{type(e).__name__}: {e}"
            else:
                half = len(part) // 2
                attempt(part.iloc[:half], at, values, reasons)
                attempt(part.iloc[half:], at + half, values, reasons)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values, reasons = [None] * len(batch), [None] * len(batch)
                attempt(batch[names], 0, values, reasons)
                # A batch goes on whole, however many of its rows fail; an object column keeps whole numbers beside nulls whole.
                yield batch.assign(**{_VALUE: pd.Series(values, batch.index, object), _REASON: pd.Series(reasons, batch.index, object)})

    return rows


def attempted(rows: DataFrame, f: Callable[[pd.DataFrame], pd.Series], kind: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with value, of the Spark type kind, and the rows that f fails on, with reason.

    f gets batches of the given columns (all by default) and gives a value for each row.  A batch that it fails on
    is tried in halves, so a few bad rows cost a few more calls, and every other row has its value.  Both tables come
    from one written table: f isn't called again when either is read.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(_VALUE, T._parse_datatype_string(kind)), T.StructField(_REASON, T.StringType())])
    tried = written(rows.mapInPandas(_attempts(f, columns or rows.columns), schema), "attempted")
    return tried.where(F.col(_REASON).isNull()).drop(_REASON), tried.where(F.col(_REASON).isNotNull()).drop(_VALUE)


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """kind (the reason up to its colon) and n of the rejected rows."""
    return rejected.groupBy(F.substring_index(_REASON, ":", 1).alias("kind")).agg(F.count("*").alias("n"))
