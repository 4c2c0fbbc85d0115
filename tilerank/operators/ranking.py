"""Ranks within a camera: best utility first, ties by tile position, then by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .numbering import number_rows


def priority_order() -> list[Column]:
    return [F.desc("utility"), F.asc("tile_index"), F.asc("lod_level")]


def rank_within_task(utilities: DataFrame) -> DataFrame:
    """Each camera is sorted by one task."""
    by_priority = Window.partitionBy("camera_uid").orderBy(*priority_order())
    return utilities.withColumn("rank", F.row_number().over(by_priority).cast("bigint"))


def rank_across_tasks(utilities: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same ranks, with each camera sorted by as many tasks as it needs."""
    return number_rows(
        utilities, priority_order(), "rank", within=["camera_uid"], partitions=partitions
    )


def ranked_pairs(ranking: DataFrame) -> DataFrame:
    """The bare result: (tile, level) at each rank of each camera."""
    return ranking.select("camera_uid", "rank", "tile_index", "lod_level")
