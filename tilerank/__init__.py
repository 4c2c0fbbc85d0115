"""Delivery order for the tiles of a 3D scene, as Spark jobs."""

from .plans import (
    flatten_utilities,
    measure_distances,
    rank_first_camera,
    rank_trajectory,
    rank_utilities,
    score_pairs,
    utilities,
)

__all__ = [
    "flatten_utilities",
    "measure_distances",
    "rank_first_camera",
    "rank_trajectory",
    "rank_utilities",
    "score_pairs",
    "utilities",
]
