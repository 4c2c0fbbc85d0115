from .heavy import Split, split_by_camera_size
from .levels import expand_levels
from .numbering import assign_positions, number_rows
from .pairing import first_camera, pair_by_mask, pair_with_camera, tile_centers
from .ranking import priority_order, rank_across_tasks, rank_within_task, ranked_pairs
from .visibility import label_tiles, mark_visible, visible_pages, visible_tiles

__all__ = [
    "Split",
    "assign_positions",
    "expand_levels",
    "first_camera",
    "label_tiles",
    "mark_visible",
    "number_rows",
    "pair_by_mask",
    "pair_with_camera",
    "priority_order",
    "rank_across_tasks",
    "rank_within_task",
    "ranked_pairs",
    "split_by_camera_size",
    "tile_centers",
    "visible_pages",
    "visible_tiles",
]
