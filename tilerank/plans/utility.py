"""From (camera, tile, visible, distance) to a ranking of (tile, level) per camera."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..constants import DEFAULT_LEVELS
from ..functions import distance_factor, flat_index, nonnegative, visibility_factor
from ..operators.heavy import (
    Split,
    pairs_for_a_task,
    partitions_for,
    split_by_camera_size,
)
from ..operators.levels import expand_levels
from ..operators.ranking import rank_across_tasks, rank_within_task
from ..schemas import checked_levels, checked_precision


def score_pairs(pairs: DataFrame, precision: str = "double") -> DataFrame:
    """Add the score of a pair and its parts."""
    return pairs.withColumns(
        {
            "vis_factor": visibility_factor(F.col("visible"), precision),
            "dist_factor": distance_factor(F.col("distance"), precision),
        }
    ).withColumn("base_score", F.col("vis_factor") * F.col("dist_factor"))


def utilities(
    scored: DataFrame, num_levels: int = DEFAULT_LEVELS, precision: str = "double"
) -> DataFrame:
    """One row per pair and level, with its ``utility``."""
    return (
        expand_levels(scored, num_levels, precision)
        .withColumn("utility", F.col("base_score") * F.col("layer_weight"))
        .drop("layer_weight")
    )


def flatten_utilities(
    scored: DataFrame, num_levels: int = DEFAULT_LEVELS, precision: str = "double"
) -> DataFrame:
    """The utilities with their row-major position among the camera's (tile, level)s."""
    return utilities(scored, num_levels, precision).withColumn(
        "flat_index", flat_index(F.col("tile_index"), F.col("lod_level"), num_levels)
    )


def _label(df: DataFrame) -> list[str]:
    return ["tile_idx"] if "tile_idx" in df.columns else []


def _to_sort(pairs: DataFrame, num_levels: int, precision: str) -> DataFrame:
    """The rows to be ranked: the sort keys and what cannot be computed again later, so
    that sorts and spills carry no more."""
    return utilities(score_pairs(pairs, precision), num_levels, precision).select(
        "camera_uid",
        "utility",
        "tile_index",
        "lod_level",
        *_label(pairs),
        "visible",
        "distance",
    )


def _ranking_columns(ranked: DataFrame, precision: str) -> DataFrame:
    return score_pairs(ranked, precision).select(
        "camera_uid",
        "rank",
        "tile_index",
        *_label(ranked),
        "lod_level",
        "visible",
        "distance",
        "base_score",
        "utility",
    )


def merge_repeats(pairs: DataFrame) -> DataFrame:
    """One row per (camera, tile): visible if any of its rows says so, as in
    ``mark_visible``. What is looked up by key is the same in all of them."""
    return pairs.groupBy("camera_uid", "tile_index").agg(
        *[F.first(name).alias(name) for name in _label(pairs)],
        F.bool_or("visible").alias("visible"),
        F.first("distance").alias("distance"),
    )


def rank_light(
    pairs: DataFrame,
    num_levels: int,
    precision: str = "double",
    partitions: int | None = None,
    gathered: bool = False,
    merge: bool = False,
) -> DataFrame:
    """Rank cameras that fit into a task.

    Pairs are brought together by camera before they are repeated per level, so the
    shuffle carries one row per pair and the window needs no other. ``gathered`` says
    that a camera's pairs are together already, as in a table bucketed by camera.
    ``merge`` makes repeated (camera, tile) rows one, without a shuffle of its own.
    """
    needed = pairs.select("camera_uid", "tile_index", *_label(pairs), "visible", "distance")
    if not gathered:
        needed = (
            needed.repartition(partitions, "camera_uid")
            if partitions
            else needed.repartition("camera_uid")
        )
    if merge:
        needed = merge_repeats(needed)
    return _ranking_columns(
        rank_within_task(_to_sort(needed, num_levels, precision)), precision
    )


def rank_heavy(
    pairs: DataFrame,
    num_levels: int,
    precision: str = "double",
    partitions: int | None = None,
    merge: bool = False,
) -> DataFrame:
    """Rank cameras of any size. Sorts and writes once, when it is called and not when
    its result is; see ``number_rows``."""
    if merge:
        pairs = merge_repeats(pairs)
    return _ranking_columns(
        rank_across_tasks(_to_sort(pairs, num_levels, precision), partitions), precision
    )


def rank_split(
    split: Split,
    prepare: Callable[[DataFrame, DataFrame | None, int | None], DataFrame],
    num_levels: int,
    precision: str = "double",
    pairs_per_task: int | None = None,
    gathered: bool = False,
    merge: bool = False,
    most_partitions: int | None = None,
) -> DataFrame:
    """Rank both parts of a split. ``prepare`` completes pairs to the columns of a score;
    it is also told the heavy cameras when it is given their pairs, and otherwise in how
    many partitions to bring pairs together, if it does that itself. ``merge`` makes
    repeated rows of a pair one."""

    rows_per_task = pairs_for_a_task(num_levels, pairs_per_task) * num_levels

    def partitions(part: DataFrame, pairs: int) -> int | None:
        return partitions_for(part, pairs * num_levels, rows_per_task, most_partitions)

    parts = []
    if split.light is not None:
        wanted = None if gathered else partitions(split.light, split.light_pairs)
        parts.append(
            rank_light(
                prepare(split.light, None, wanted),
                num_levels,
                precision,
                wanted,
                gathered,
                merge,
            )
        )
    if split.heavy is not None:
        parts.append(
            rank_heavy(
                prepare(split.heavy, split.heavy_cameras, None),
                num_levels,
                precision,
                partitions(split.heavy, split.heavy_pairs),
                merge,
            )
        )
    return reduce(DataFrame.unionByName, parts)


def rank_utilities(
    pairs: DataFrame,
    num_levels: int = DEFAULT_LEVELS,
    *,
    precision: str = "double",
    pairs_per_task: int | None = None,
    camera_sizes: DataFrame | None = None,
    gathered: bool = False,
    most_partitions: int | None = None,
) -> DataFrame:
    """Rank all (tile, level) of each camera by descending utility.

    ``pairs`` has ``camera_uid, tile_index, visible, distance`` and perhaps
    ``tile_idx``. A NULL ``visible`` counts as not visible, a negative distance is an
    error, a NaN distance ranks first and a NULL distance last. Each given row is ranked.

    One small job counts pairs per camera (see ``split_by_camera_size`` for
    ``camera_sizes``, which help where pairs are costly to compute). If no camera has
    more than ``pairs_per_task``, by default what makes ``ROWS_PER_TASK`` rows, nothing
    else runs before the result is asked for. Otherwise the larger cameras are sorted and
    written at once, so that a filter on the result comes too late for them.
    ``most_partitions`` bounds the partitions of a shuffle; without it they are as many
    as the counted rows ask for.
    """
    checked_levels(num_levels)
    checked_precision(precision)
    return rank_split(
        split_by_camera_size(
            pairs, pairs_for_a_task(num_levels, pairs_per_task), camera_sizes
        ),
        lambda part, *_: part.withColumn(
            "distance", nonnegative(F.col("distance"), precision)
        ),
        num_levels,
        precision,
        pairs_per_task,
        gathered,
        most_partitions=most_partitions,
    )
