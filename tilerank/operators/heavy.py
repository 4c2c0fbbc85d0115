"""Telling apart the cameras that are too large to be sorted by one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import ROWS_PER_PARTITION, ROWS_PER_TASK
from ..sources.workspace import stored


@dataclass(frozen=True)
class Split:
    """``light`` holds whole cameras of bounded size, ``heavy`` all others. A part that
    is known to be empty is None; they never both are."""

    light: DataFrame | None
    light_pairs: int = 0
    heavy: DataFrame | None = None
    heavy_cameras: DataFrame | None = None
    heavy_pairs: int = 0


def count_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs per camera: reads one column and combines before its shuffle."""
    return pairs.groupBy("camera_uid").agg(F.count(F.lit(1)).alias("pairs"))


def split_by_camera_size(
    pairs: DataFrame, pairs_per_task: int, camera_sizes: DataFrame | None = None
) -> Split:
    """Split pairs by whether their camera has more than ``pairs_per_task`` of them.

    ``camera_sizes`` (``camera_uid, pairs``) saves the counting where sizes, or upper
    bounds of them, are cheaper to come by. It must list every camera: one missing there
    is taken to be light. Rows without a camera are one camera like any other.

    There are fewer than rows / ``pairs_per_task`` heavy cameras. Their list is written,
    so that both halves see the same one and the optimizer knows its size: it is
    broadcast if small enough, and joined by key if not.
    """
    sizes = count_pairs(pairs) if camera_sizes is None else camera_sizes
    is_heavy = F.col("pairs") > pairs_per_task
    totals = sizes.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(is_heavy, F.col("pairs"))), F.lit(0)).alias("heavy"),
    ).first()
    if not totals["heavy"]:
        return Split(pairs, totals["all"])
    cameras = stored(sizes.where(is_heavy).select("camera_uid"), "heavy-cameras")
    same = pairs["camera_uid"].eqNullSafe(cameras["camera_uid"])
    light_pairs = totals["all"] - totals["heavy"]
    all_heavy = camera_sizes is None and light_pairs == 0
    return Split(
        light=None if all_heavy else pairs.join(cameras, same, "left_anti"),
        light_pairs=light_pairs,
        heavy=pairs.join(cameras, same, "left_semi"),
        heavy_cameras=cameras,
        heavy_pairs=totals["heavy"],
    )


def pairs_for_a_task(num_levels: int, pairs_per_task: int | None = None) -> int:
    """The given limit, or else as many pairs as make ``ROWS_PER_TASK`` rows."""
    if pairs_per_task is None:
        return max(ROWS_PER_TASK // num_levels, 1)
    return pairs_per_task


def partitions_for(
    df: DataFrame, rows: int, rows_per_task: int, most: int | None = None
) -> int | None:
    """Shuffle partitions for so many rows; None where the session's own number is
    enough (adaptive execution may then still merge small ones, and a join by the same
    key before needs no further shuffle). It is not where merging could make partitions
    of more than ``ROWS_PER_PARTITION`` rows: their compressed bytes, by which they are
    merged, say little about the memory that they take. With ``most``, partitions beyond
    that number grow instead, and spill."""
    target = max(min(rows_per_task, ROWS_PER_PARTITION), 1)
    wanted = -(-rows // target)
    if most is not None:
        wanted = min(wanted, most)
    conf = df.sparkSession.conf
    own = conf.get(
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum", None
    ) or conf.get("spark.sql.shuffle.partitions")
    large = rows > _fewest_merged(df.sparkSession) * ROWS_PER_PARTITION
    return wanted if wanted > int(own) or large else None


def _fewest_merged(spark: SparkSession) -> int:
    """How few partitions adaptive execution may leave, whatever their bytes."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    if first.lower() != "true":
        return 1
    fewest = spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionNum", None)
    return int(fewest or spark.sparkContext.defaultParallelism)
