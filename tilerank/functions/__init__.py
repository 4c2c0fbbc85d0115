from .geometry import box_center, point, point_distance
from .scoring import (
    distance_factor,
    flat_index,
    flat_level,
    flat_tile,
    level_weight,
    nonnegative,
    visibility_factor,
)

__all__ = [
    "box_center",
    "distance_factor",
    "flat_index",
    "flat_level",
    "flat_tile",
    "level_weight",
    "nonnegative",
    "point",
    "point_distance",
    "visibility_factor",
]
