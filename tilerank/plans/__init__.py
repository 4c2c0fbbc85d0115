from .trajectory import measure_distances, rank_first_camera, rank_trajectory
from .utility import flatten_utilities, rank_utilities, score_pairs, utilities

__all__ = [
    "flatten_utilities",
    "measure_distances",
    "rank_first_camera",
    "rank_trajectory",
    "rank_utilities",
    "score_pairs",
    "utilities",
]
