"""Bringing cameras and tiles together.

Pairs are never made up here: a mask says which camera is to rank which tile, with one
row for each pair, and both sides are looked up by key. One camera needs no mask to meet
every tile, as it is a single value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import box_center, point, point_distance


def tile_centers(tiles: DataFrame, precision: str = "double") -> DataFrame:
    """Tiles with ``center`` instead of their corners."""
    return tiles.select(
        "tile_index",
        "tile_idx",
        box_center(F.col("min_corner"), F.col("max_corner"), precision).alias("center"),
    )


UNKNOWN = ("raise", "drop")


def pair_by_mask(
    mask: DataFrame,
    tiles: DataFrame,
    cameras: DataFrame,
    precision: str = "double",
    *,
    unknown: str = "raise",
    partitions: int | None = None,
    few_cameras: bool = False,
) -> DataFrame:
    """Mask rows with ``tile_idx`` and the camera's ``distance`` to the tile's centre.

    A row that names no known tile or camera is an error when the result is computed,
    unless ``unknown`` is "drop", which leaves such rows out.

    The camera is looked up last: if that lookup shuffles, the ranking that follows
    finds its rows already together by camera. With ``partitions``, rows are brought
    together in so many partitions before, and nowhere else. Centres travel there as
    plain columns, which take less room than a struct. ``few_cameras`` says that
    ``cameras`` holds only some of the cameras: they are looked up first, and rows of
    others are left out.
    """
    if unknown not in UNKNOWN:
        raise ValueError(f"unknown is one of {UNKNOWN}, not {unknown!r}")
    how = "left" if unknown == "raise" else "inner"
    centers = tile_centers(tiles, precision).select(
        "tile_index",
        "tile_idx",
        *[F.col(f"center.{a}").alias(f"_{a}") for a in "xyz"],
        F.lit(True).alias("_tile"),
    )
    places = cameras.select("camera_uid", "camera_center", F.lit(True).alias("_camera"))
    if few_cameras:
        rows = mask.join(places, "camera_uid").join(centers, "tile_index", how)
    else:
        rows = mask.join(centers, "tile_index", how)
        if partitions:
            rows = rows.repartition(partitions, "camera_uid")
        rows = rows.join(places, "camera_uid", how)
    center = point(F.col("_x"), F.col("_y"), F.col("_z"), precision)
    distance = point_distance(center, F.col("camera_center"), precision)
    if unknown == "raise":
        known = F.col("_tile").isNotNull() & F.col("_camera").isNotNull()
        message = F.concat(
            F.lit("the mask names a tile or camera that is not known: camera "),
            F.coalesce(F.col("camera_uid").cast("string"), F.lit("NULL")),
            F.lit(", tile "),
            F.coalesce(F.col("tile_index").cast("string"), F.lit("NULL")),
        )
        # In a filter, so that it is evaluated whichever columns are asked for.
        rows = rows.where(F.when(known, True).otherwise(F.raise_error(message)))
    return rows.select(
        "camera_uid", "tile_index", "tile_idx", "visible", distance.alias("distance")
    )


def first_camera(cameras: DataFrame) -> DataFrame:
    """The first camera of the trajectory; one row, or none. The same one each time it is
    computed, also if two share a place."""
    return cameras.orderBy("camera_ord", "camera_uid").limit(1)


def pair_with_camera(
    tiles: DataFrame, camera: DataFrame, precision: str = "double"
) -> DataFrame:
    """Every tile with the one camera in ``camera``, read as a scalar subquery."""
    value = camera.select(F.struct("camera_uid", "camera_center")).scalar()
    return (
        tiles.withColumn("_camera", value)
        .where(F.col("_camera").isNotNull())
        .select(
            F.col("_camera.camera_uid").alias("camera_uid"),
            "tile_index",
            "tile_idx",
            "min_corner",
            "max_corner",
            F.col("_camera.camera_center").alias("camera_center"),
            point_distance(
                box_center(F.col("min_corner"), F.col("max_corner"), precision),
                F.col("_camera.camera_center"),
                precision,
            ).alias("distance"),
        )
    )
