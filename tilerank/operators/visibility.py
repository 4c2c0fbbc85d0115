"""What a camera sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import PAGE_TILES


def mark_visible(pairs: DataFrame, sightings: DataFrame) -> DataFrame:
    """Add ``visible`` to pairs from a table that lists the visible pairs (its own
    ``visible`` column, if it has one, is respected). A pair not listed is not visible;
    one listed repeatedly is visible if any of its rows says so.
    """
    if "visible" not in sightings.columns:
        sightings = sightings.withColumn("visible", F.lit(True))
    # Repeats are merged before the shuffle that the join needs anyway.
    seen = sightings.groupBy("camera_uid", "tile_index").agg(
        F.bool_or("visible").alias("_seen")
    )
    return (
        pairs.join(seen, ["camera_uid", "tile_index"], "left")
        .withColumn("visible", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
    )


def visible_tiles(mask: DataFrame) -> DataFrame:
    return mask.where("visible").select("camera_uid", "tile_index")


def label_tiles(pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Add the label ``tile_idx`` of each tile position."""
    return pairs.join(tiles.select("tile_index", "tile_idx"), "tile_index")


def visible_pages(labelled: DataFrame, page_tiles: int = PAGE_TILES) -> DataFrame:
    """Per camera, the labels of the tiles it sees, by ascending tile position.

    The list comes in pages: ``page`` n covers positions n x page_tiles onwards, so one
    group never holds more than ``page_tiles`` entries, and the pages in order are the
    whole list. A page in which the camera sees nothing is kept, with an empty list.
    """
    seen = F.when(F.col("visible"), F.struct("tile_index", "tile_idx"))
    page = F.call_function("div", F.col("tile_index"), F.lit(page_tiles).cast("bigint"))
    return (
        labelled.groupBy("camera_uid", page.alias("page"))
        .agg(F.array_sort(F.collect_list(seen)).alias("_seen"))
        .select("camera_uid", "page", F.col("_seen.tile_idx").alias("visible_tile_idxs"))
    )
