"""Column expressions for the parts of a score and for flat positions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import DISTANCE_OFFSET, HIDDEN_FACTOR, LEVEL_BASE, VISIBLE_FACTOR


def visibility_factor(
    visible: Column,
    precision: str = "double",
    visible_factor: float = VISIBLE_FACTOR,
    hidden_factor: float = HIDDEN_FACTOR,
) -> Column:
    """Unseen tiles (also NULL) keep a small factor, so that they are never starved."""
    return (
        F.when(visible, F.lit(visible_factor)).otherwise(F.lit(hidden_factor)).cast(precision)
    )


def distance_factor(
    distance: Column, precision: str = "double", offset: float = DISTANCE_OFFSET
) -> Column:
    return (F.lit(1.0) / (distance + F.lit(offset).cast(precision))).cast(precision)


def nonnegative(distance: Column, precision: str = "double") -> Column:
    """The distance itself, or an error when a row with a negative one is evaluated."""
    complaint = F.raise_error(F.concat(F.lit("negative distance: "), distance.cast("string")))
    return F.when(distance < 0, complaint.cast(precision)).otherwise(distance.cast(precision))


def level_weight(
    level: Column, num_levels: int, precision: str = "double", base: float = LEVEL_BASE
) -> Column:
    """The base layer weighs most; each further level weighs ``base`` times less."""
    return F.pow(F.lit(base), F.lit(num_levels - 1) - level).cast(precision)


def flat_index(tile_index: Column, level: Column, num_levels: int) -> Column:
    """Row-major position of (tile, level)."""
    return tile_index * F.lit(num_levels).cast("bigint") + level


def flat_tile(flat: Column, num_levels: int) -> Column:
    return F.call_function("div", flat, F.lit(num_levels).cast("bigint"))


def flat_level(flat: Column, num_levels: int) -> Column:
    return flat % F.lit(num_levels).cast("bigint")
