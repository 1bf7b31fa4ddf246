"""Column expressions that the operators share: clocks, angles, sizes and guards.

Angles are radians. ``nanless`` stands at every boundary where data may hold NaN, since Spark orders NaN above all
numbers while the operators mean "no value" by it; from there on NULL is the only sign for a missing value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts, origin: str = "2024-01-01 00:00:00") -> Column:
    """Seconds of a timestamp without time zone since ``origin``, with its microseconds."""
    return F.timestamp_diff("MICROSECOND", F.lit(origin).cast("timestamp_ntz"), ts) / F.lit(1e6)


def nanless(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x), x)


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def quotient(a: Column, b: Column) -> Column:
    """a / b by IEEE 754, as NumPy and DuckDB have it: infinite or NaN where b is 0, of either sign, taken for +0."""
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(a / b)


def finite(x) -> Column:
    """x, NULL where it is NaN or infinite."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def wrapped(angle: Column) -> Column:
    """The same direction in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def cartesian(phi: Column, theta: Column, rho=1.0) -> tuple[Column, Column, Column]:
    """(x, y, z) of a direction: z ahead, y up; phi is the heading from z to x, theta the angle from y."""
    flat = F.lit(rho) * F.sin(theta)
    return flat * F.sin(phi), F.lit(rho) * F.cos(theta), flat * F.cos(phi)


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(rho, theta, phi) of a point; theta is NULL at the origin."""
    rho = F.sqrt(x * x + y * y + z * z)
    return rho, F.acos(ratio(y, rho)), F.atan2(x, z)


def angular_size(size, dist: Column, least: float = 0.0) -> Column:
    """Angle under which something of half-width ``size`` is seen from ``dist``."""
    return F.lit(2.0) * F.atan2(F.lit(float(size)), F.greatest(dist, F.lit(float(least))))


def salience(dist: Column, clip: float) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - dist / F.lit(float(clip)))


def field_of_view(degrees: float, axis: str, aspect: float) -> tuple[float, float]:
    """(horizontal, vertical) opening in radians when ``degrees`` is meant along ``axis``; aspect is width over height."""
    half = math.radians(degrees) / 2
    if axis == "vertical":
        return 2 * math.atan2(math.sin(half) * aspect, math.cos(half)), 2 * half
    if axis == "horizontal":
        return 2 * half, 2 * math.atan2(math.sin(half) / aspect, math.cos(half))
    raise ValueError(f"axis is 'vertical' or 'horizontal', not {axis!r}")


def cell_name(name: Column) -> Column:
    """Struct (stat, row, col) of names such as mean_r0c3; NULL for other names."""
    form = r"^([a-z]+)_r([0-9]+)c([0-9]+)$"
    parts = F.struct(F.regexp_extract(name, form, 1).alias("stat"), *[F.regexp_extract(name, form, i).try_cast("int").alias(k) for i, k in ((2, "row"), (3, "col"))])
    return F.when(name.rlike(form), parts)


def bounds(length: int, cells: int) -> list[int]:
    """Edges of ``cells`` cells over ``length`` pixels: evenly spaced and cut down to whole pixels."""
    return [int(k * length / cells) for k in range(cells)] + [length]


def cell_of(pixel: Column, edges: list[int]) -> Column:
    """Which cell a pixel lies in; NULL outside."""
    inside = F.array(*[F.lit(e) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<int>")
    return F.when(pixel.between(edges[0], edges[-1] - 1), F.size(F.filter(inside, lambda e: e <= pixel)))
