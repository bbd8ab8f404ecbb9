"""Masking of whole words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import MODULUS, MULTIPLIER


def whole_words(rows: DataFrame, key: str, tokens: str, seed: int = 0, share: float = 0.15, most: int = 512, specials: tuple[str, ...] = ("[CLS]", "[SEP]")) -> DataFrame:
    """(key, pos) of the masked tokens of each block (key, tokens): words, which are a token and those with ## after
    it, in the order of a hash, as many as fit the budget of round(size * share) tokens, 1 at least.

    A word that would exceed the budget is passed over.  A block is of a model's length.
    """
    kind = rows.schema[key].dataType.simpleString()
    budget = F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.size(tokens) * F.lit(share)).cast("int")))
    return rows.select(F.col(key), budget.cast("int").alias("budget"), F.col(key).cast("bigint").alias("number"), F.col(tokens).alias("tokens")).mapInArrow(_masked(seed, list(specials)), f"{key} {kind}, pos int")


def _masked(seed: int, specials: list[str]):
    """A block is a row, so nothing is shuffled."""

    def hashed(x: np.ndarray) -> np.ndarray:
        """portable_hash of numbers under 2 ** 31."""
        first = (x + seed) * MULTIPLIER % MODULUS
        return ((first >> 7) * (2246822519 % (1 << 31)) + first) % MODULUS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, budgets = batch.column(3), batch.column(1).to_pylist()
            flat, n = tokens.flatten(), pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            free = pc.and_(pc.is_valid(flat), pc.invert(pc.is_in(flat, pa.array(specials, flat.type)))).to_numpy(zero_copy_only=False)
            follows = pc.fill_null(pc.starts_with(flat, "##"), False).to_numpy(zero_copy_only=False)[free]
            row, pos = row[free], pos[free]
            begins = np.flatnonzero(~follows | (np.diff(row, prepend=-1) != 0))
            size = np.diff(np.append(begins, len(row)))
            of, first = row[begins], pos[begins]
            key = batch.column(2).to_numpy(zero_copy_only=False)[of] * 4096 + first
            order = np.lexsort((first, hashed(key % (1 << 31)), of))
            taken, chosen = [0] * len(n), np.zeros(len(begins), bool)
            for word, r, k in zip(order.tolist(), of[order].tolist(), size[order].tolist(), strict=True):
                if taken[r] + k <= budgets[r]:
                    taken[r] += k
                    chosen[word] = True
            held = np.repeat(chosen, size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[held])), pa.array(pos[held].astype(np.int32))], [batch.schema.names[0], "pos"])

    return rows
