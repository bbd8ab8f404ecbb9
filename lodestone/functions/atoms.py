"""Atoms: radii, masses, feature bits, shapes and rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Van der Waals radii by atomic number, 1 to 103.
VDW_RADII = [
    1.1, 1.4, 1.82, 1.53, 1.92, 1.7, 1.55, 1.52, 1.47, 1.54, 2.27, 1.73, 1.84, 2.1, 1.8, 1.8, 1.75, 1.88, 2.75, 2.31,
    2.15, 2.11, 2.07, 2.06, 2.05, 2.04, 2.0, 1.97, 1.96, 2.01, 1.87, 2.11, 1.85, 1.9, 1.85, 2.02, 3.03, 2.49, 2.32, 2.23,
    2.18, 2.17, 2.16, 2.13, 2.1, 2.1, 2.11, 2.18, 1.93, 2.17, 2.06, 2.06, 1.98, 2.16, 3.43, 2.68, 2.43, 2.42, 2.4, 2.39,
    2.38, 2.36, 2.35, 2.34, 2.33, 2.31, 2.3, 2.29, 2.27, 2.26, 2.24, 2.23, 2.22, 2.18, 2.16, 2.16, 2.13, 2.13, 2.14, 2.23,
    1.96, 2.02, 2.07, 1.97, 2.02, 2.2, 3.48, 2.83, 2.47, 2.45, 2.43, 2.41, 2.39, 2.43, 2.44, 2.45, 2.44, 2.45, 2.45, 2.45,
    2.46, 2.46, 2.46,
]
# Monoisotopic masses.
MASSES = {"H": 1.00782503207, "B": 11.0093054, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "F": 18.99840322, "Si": 27.9769265325, "P": 30.97376163, "S": 31.972071, "Cl": 34.96885268, "Br": 78.9183371, "I": 126.904473}
# Atomic numbers.
NUMBERS = {"H": 1, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Na": 11, "Mg": 12, "Si": 14, "P": 15, "S": 16, "Cl": 17, "K": 19, "Ca": 20, "Mn": 25, "Fe": 26, "Zn": 30, "Se": 34, "Br": 35, "I": 53}
RECEPTOR, LIGAND = [6, 8, 7, 16], [6, 8, 7]


def vdw_radius(number: Column) -> Column:
    """0 for an unknown atomic number."""
    return F.coalesce(F.get(F.array(*map(F.lit, VDW_RADII)), (number - 1).cast("int")), F.lit(0.0))


def atomic_mask(number: Column, layers: list[int]) -> Column:
    """The bit of the number's place in layers; 0 if it has none."""
    at = F.array_position(F.array(*map(F.lit, layers)), number.cast("int"))
    return F.when(at > 0, F.call_function("shiftleft", F.lit(1), (at - 1).cast("int"))).otherwise(0)


def heavy_mask(number: Column, layers: list[int]) -> Column:
    """As atomic_mask, with one more bit for all other heavy atoms; hydrogen has none."""
    return F.when(number <= 1, 0).when(number.isin(layers), atomic_mask(number, layers)).otherwise(1 << len(layers))


def rotated(rot: tuple[Column, ...], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """q v q* for the unit quaternion rot = (w, x, y, z)."""
    w, a, b, c = rot
    return (
        (1 - 2 * (b * b + c * c)) * x + 2 * (a * b - w * c) * y + 2 * (a * c + w * b) * z,
        2 * (a * b + w * c) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - w * a) * z,
        2 * (a * c - w * b) * x + 2 * (b * c + w * a) * y + (1 - 2 * (a * a + b * b)) * z,
    )


def density(shape: str, d2: Column, r: Column, dx: Column, dy: Column, dz: Column, res: float) -> Column:
    """What an atom of radius r adds at a point at squared distance d2; null where it adds nothing.

    All shapes are cut by the cube of half side r ** 2 first.
    """
    r2 = r * r
    if shape == "exp":
        value = F.when(d2 <= r2, F.exp(-2 * d2 / r2))
    elif shape == "sphere":
        value = F.when(d2 <= r2, F.lit(1.0))
    elif shape == "cube":
        value = F.lit(1.0)
    elif shape == "gaussian":
        d = F.sqrt(d2)
        value = F.when(d <= r, F.exp(-2 * d2 / r2)).when(d <= 1.5 * r, F.exp(F.lit(-2.0)) * (4 * d2 / r2 - 12 * d / r + 9))
    elif shape == "lj":
        d = F.sqrt(d2)
        value = F.when(d == 0, F.lit(1.0)).when(d <= 1.5 * r, 1 - F.exp(-F.pow(r / d, F.lit(12.0))))
    elif shape == "discrete":
        value = F.when((F.abs(dx) < res / 2) & (F.abs(dy) < res / 2) & (F.abs(dz) < res / 2), F.lit(1.0))
    else:
        raise ValueError(f"unknown shape: {shape}")
    return F.when((F.abs(dx) <= r2) & (F.abs(dy) <= r2) & (F.abs(dz) <= r2), value)


SHAPES = ["exp", "sphere", "cube", "gaussian", "lj", "discrete"]


def reach(shape: str, r: Column, res: float) -> Column:
    """No point farther than this along any axis can be touched."""
    if shape in ("exp", "sphere"):
        return r
    if shape in ("gaussian", "lj"):
        return 1.5 * r
    return r * r if shape == "cube" else F.least(r * r, F.lit(res / 2))


def random_quaternion(key: Column, seed: int = 0) -> tuple[Column, Column, Column, Column]:
    """A uniform unit quaternion: four normal numbers from the portable hash of a key, over their length."""
    from .tokens import portable_hash

    u = lambda i: (portable_hash(key * 8 + i, seed) + 0.5) / 4294967296.0
    n = [F.sqrt(-2 * F.ln(u(2 * i))) * f(2 * 3.141592653589793 * u(2 * i + 1)) for i in (0, 1) for f in (F.cos, F.sin)]
    length = F.sqrt(sum(x * x for x in n))
    return tuple(x / length for x in n)
