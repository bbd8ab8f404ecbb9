"""Named column builders: fingerprints and atom featurizers, to which a user adds their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .atoms import LIGAND, RECEPTOR, heavy_mask, vdw_radius
from .vectors import bit_or

#: Name -> a function from the columns of single fingerprints, by their names, to one array.
FINGERPRINTS: dict[str, Callable[[dict[str, Column]], Column]] = {
    "rdk10": lambda c: c["rdk10"],
    "rdk10_x_morgan": lambda c: bit_or(c["rdk10"], c["morgan"]),
    "language_model": lambda c: c["language_model"],
}

#: Name -> a function from the atomic number to mask and radius.
FEATURIZERS: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "receptor": lambda n: (heavy_mask(n, RECEPTOR), vdw_radius(n)),
    "ligand": lambda n: (heavy_mask(n, LIGAND), vdw_radius(n)),
}


def fingerprint(name: str, columns: dict[str, Column]) -> Column:
    if name not in FINGERPRINTS:
        raise ValueError(f"no fingerprint {name}")
    return FINGERPRINTS[name](columns)


def featurized(name: str, number: Column) -> Column:
    """mask and radius, as a struct."""
    if name not in FEATURIZERS:
        raise ValueError(f"no featurizer {name}")
    mask, radius = FEATURIZERS[name](number)
    return F.struct(mask.alias("mask"), radius.alias("radius"))


def validated(features: Column, valid: Column, size: int) -> Column:
    """features and valid, as a struct: zeros where a text isn't valid or has none."""
    good = F.coalesce(valid & features.isNotNull(), F.lit(False))
    return F.struct(F.when(good, features).otherwise(F.array_repeat(F.lit(0.0), size)).alias("features"), good.alias("valid"))


def descriptors(names: list[str], size: int | None = None) -> list[str]:
    """The names in order, the first size of them."""
    return sorted(names)[:size]
