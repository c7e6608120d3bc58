"""Scalar geometry as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def vector(prefix: str = "", names: tuple[str, ...] = ("x", "y", "z")) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def distance_sq(a: list[Column], b: list[Column]) -> Column:
    d = minus(a, b)
    return dot(d, d)


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(distance_sq(a, b))


def unit(v: list[Column]) -> list[Column]:
    """Direction of ``v``; the zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return [F.when(n > 0, x / n).otherwise(F.lit(0.0)) for x in v]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def angle_degrees(a: list[Column], b: list[Column]) -> Column:
    """Angle between two vectors; 0 when one has hardly any length."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < EPSILON) | (nb < EPSILON), F.lit(0.0)).otherwise(F.degrees(F.acos(clamp(dot(a, b) / (na * nb), -1.0, 1.0))))


def undirected_angle_degrees(a: list[Column], b: list[Column]) -> Column:
    return F.degrees(F.acos(F.least(F.abs(dot(a, b)), F.lit(1.0))))


def direction_score(direction: list[Column], at: list[Column], to: list[Column]) -> Column:
    """How far ``to`` lies ahead of ``at``: cosine to the (not normalised) direction; -1 if they coincide."""
    d = distance(to, at)
    return F.when(d < EPSILON, F.lit(-1.0)).otherwise(dot(direction, minus(to, at)) / d)


def normalise_theta(theta: Column) -> Column:
    """Angle modulo pi in [0, pi); infinite angles become null."""
    finite = ~theta.isin(float("inf"), float("-inf"))
    return F.when(finite, F.pmod(theta, F.lit(math.pi)))


def intensity(u8: Column) -> Column:
    """A byte as single-precision 0..1."""
    return (u8.cast("double") / 255.0).cast("float")


def grid_cell(x: Column, low: Column, cell: float) -> Column:
    """Cell number from the lower bound, truncated towards zero."""
    return ((x - low) / cell).cast("int")


def cell_centre(low: Column, g: Column, cell: float) -> Column:
    return low + g * cell + cell / 2


def rotation(q0: Column, q1: Column, q2: Column, q3: Column) -> list[Column]:
    """Row-major 3x3 rotation of the quaternion x=q0, y=q1, z=q2, w=q3, taken as it is."""
    x, y, z, w = q0, q1, q2, q3
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def rigid(r: list[Column], t: list[Column]) -> list[Column]:
    """Row-major 4x4 matrix of a rotation and a translation."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return [*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], zero, zero, zero, one]


def matrix_product(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 arrays. One expression for all cells: written out cell by cell,
    a chain of products outgrows what can be compiled."""

    def cell(i: Column) -> Column:
        row, column = F.floor(i / 4).cast("int"), i % 4
        return F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda acc, k: acc + F.get(a, row * 4 + k) * F.get(b, k * 4 + column))

    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def apply_matrix(m: list[Column], p: list[Column]) -> list[Column]:
    return [m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3)]


def identity() -> list[Column]:
    return [F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)]


def stem_index(path: Column) -> Column:
    """The integer that is a file stem; null where there is none."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1).try_cast("int")
