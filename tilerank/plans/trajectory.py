"""Whole jobs: tiles, cameras and masks in, rankings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import DEFAULT_LEVELS
from ..operators.heavy import pairs_for_a_task, split_by_camera_size
from ..operators.pairing import first_camera, pair_by_mask, pair_with_camera
from ..operators.visibility import mark_visible
from ..schemas import (
    cameras_schema,
    checked_levels,
    checked_precision,
    conform,
    mask_schema,
    tiles_schema,
)
from ..sources.workspace import stored
from .utility import rank_split


def measure_distances(
    tiles: DataFrame,
    cameras: DataFrame,
    mask: DataFrame,
    precision: str = "double",
    *,
    unknown: str = "raise",
) -> DataFrame:
    """Distance from each camera to the centre of each tile of its mask, for each row of
    the mask. ``unknown`` is that of ``pair_by_mask``."""
    checked_precision(precision)
    return pair_by_mask(
        conform(mask, mask_schema()),
        conform(tiles, tiles_schema(precision)),
        conform(cameras, cameras_schema(precision)),
        precision,
        unknown=unknown,
    )


def check_complete(tiles: DataFrame, cameras: DataFrame, mask: DataFrame) -> None:
    """Raise ``ValueError`` unless the mask has each tile for each camera, repeats aside.

    Distinct pairs are counted per camera, in a job of its own over two columns of the
    mask; nothing is paired up. Tiles and cameras must not be listed twice.
    """
    for table, key in ((tiles, "tile_index"), (cameras, "camera_uid")):
        twice = table.groupBy(key).count().where("count > 1").first()
        if twice:
            raise ValueError(f"{key} {twice[0]} is listed {twice[1]} times")
    n_tiles = tiles.count()
    found = (
        mask.select("camera_uid", "tile_index")
        .distinct()
        .join(tiles.select("tile_index"), "tile_index", "left_semi")
        .groupBy("camera_uid")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    short = (
        cameras.select("camera_uid")
        .join(found, "camera_uid", "left")
        .select("camera_uid", F.coalesce("found", F.lit(0)).alias("found"))
        .where(F.col("found") != n_tiles)
        .first()
    )
    if short:
        raise ValueError(
            f"the mask has {short['found']} of {n_tiles} tiles for camera {short['camera_uid']}"
        )


def rank_trajectory(
    tiles: DataFrame,
    cameras: DataFrame,
    mask: DataFrame,
    num_levels: int = DEFAULT_LEVELS,
    *,
    precision: str = "double",
    pairs_per_task: int | None = None,
    camera_sizes: DataFrame | None = None,
    gathered: bool = False,
    unknown: str = "raise",
    complete: bool = False,
    most_partitions: int | None = None,
) -> DataFrame:
    """Rank the tiles of every camera's mask, all cameras in one job.

    The mask is the large table: one row per camera and tile. Tiles and cameras are
    looked up by key, so the work grows with the mask. A pair listed repeatedly is ranked
    once, and is visible if any of its rows says so. A row that names an unknown tile or
    camera is an error when the ranking is computed, or left out with ``unknown="drop"``.

    Only pairs of the mask are ranked. ``complete=True`` first makes sure that it has
    each tile for each camera (see ``check_complete``), and raises if not.
    ``camera_sizes``, ``gathered`` and ``most_partitions`` are as in ``rank_utilities``
    and ``rank_light``; as there, cameras above ``pairs_per_task`` are sorted at once.
    """
    checked_levels(num_levels)
    checked_precision(precision)
    tiles = conform(tiles, tiles_schema(precision))
    cameras = conform(cameras, cameras_schema(precision))
    mask = conform(mask, mask_schema())
    if complete:
        check_complete(tiles, cameras, mask)

    def prepare(
        part: DataFrame, heavy_cameras: DataFrame | None, partitions: int | None
    ) -> DataFrame:
        if heavy_cameras is None:
            return pair_by_mask(
                part, tiles, cameras, precision, unknown=unknown, partitions=partitions
            )
        # Few rows: written, so that the optimizer sees that. Looking them up in the whole
        # mask also picks out the heavy cameras' rows, so nothing else needs to. A heavy
        # camera that is not known stays in the list, without a place.
        how = "left" if unknown == "raise" else "inner"
        few = stored(heavy_cameras.join(cameras, "camera_uid", how), "heavy-centers")
        if unknown == "raise" and (lost := few.where("camera_center IS NULL").first()):
            raise ValueError(f"the mask names camera {lost['camera_uid']}, which is not known")
        return pair_by_mask(mask, tiles, few, precision, unknown=unknown, few_cameras=True)

    return rank_split(
        split_by_camera_size(
            mask, pairs_for_a_task(num_levels, pairs_per_task), camera_sizes
        ),
        prepare,
        num_levels,
        precision,
        pairs_per_task,
        gathered,
        merge=True,
        most_partitions=most_partitions,
    )


def rank_first_camera(
    tiles: DataFrame,
    cameras: DataFrame,
    mask: DataFrame,
    num_levels: int = DEFAULT_LEVELS,
    *,
    precision: str = "double",
    pairs_per_task: int | None = None,
    most_partitions: int | None = None,
) -> DataFrame:
    """Rank every tile for the first camera of the trajectory.

    Here the mask may leave tiles out: they count as not visible.
    """
    checked_levels(num_levels)
    checked_precision(precision)
    camera = first_camera(conform(cameras, cameras_schema(precision)))
    pairs = pair_with_camera(conform(tiles, tiles_schema(precision)), camera, precision)
    uid = camera.select("camera_uid").scalar()
    seen = conform(mask, mask_schema()).where(F.col("camera_uid") == uid)
    return rank_split(
        split_by_camera_size(pairs, pairs_for_a_task(num_levels, pairs_per_task)),
        lambda part, *_: mark_visible(part, seen),
        num_levels,
        precision,
        pairs_per_task,
        most_partitions=most_partitions,
    )
