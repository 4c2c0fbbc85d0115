"""Column expressions over points, stored as ``struct<x,y,z>``.

In ``float`` precision every step is rounded to 32 bits. ``/`` and ``sqrt`` give
doubles, and rounding those once afterwards equals 32-bit arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def point(x: Column, y: Column, z: Column, precision: str = "double") -> Column:
    return F.struct(
        x.cast(precision).alias("x"), y.cast(precision).alias("y"), z.cast(precision).alias("z")
    )


def box_center(low: Column, high: Column, precision: str = "double") -> Column:
    return point(*[(low[axis] + high[axis]) / 2 for axis in "xyz"], precision=precision)


def point_distance(a: Column, b: Column, precision: str = "double") -> Column:
    """Euclidean distance; squares are added in axis order."""
    dx, dy, dz = [a[axis] - b[axis] for axis in "xyz"]
    return F.sqrt(dx * dx + dy * dy + dz * dz).cast(precision)
