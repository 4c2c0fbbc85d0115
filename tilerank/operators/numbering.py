"""Row numbers in a stated order, where no group has to fit into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import ROWS_PER_PARTITION
from ..sources.workspace import stored

# monotonically_increasing_id(): partition number above bit 33, row below.
_PARTITION_SHIFT = 33


def number_rows(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str,
    within: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add 1-based ``name``: the row's place by ``order`` within its ``within`` group.

    The rows are range-partitioned by group and order, so that a group spreads over as
    many tasks as its size asks for, also when all its leading order values are equal.
    Sorted once and written, each row then knows its slot in its partition; what is left
    is to add, per group and partition, the rows the group has in earlier partitions.
    That table has at most (groups + partitions) rows.
    """
    keys = [F.col(column) for column in within] + list(order)
    ranged = (
        df.repartitionByRange(partitions, *keys)
        if partitions
        else df.repartitionByRange(*keys)
    )
    placed = stored(
        ranged.sortWithinPartitions(*keys).withColumn(
            "_slot", F.monotonically_increasing_id()
        ),
        "placed",
    ).withColumn("_part", F.shiftrightunsigned("_slot", _PARTITION_SHIFT))

    runs = placed.groupBy(*within, "_part").agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per partition that the group touches.
    earlier = (
        Window.partitionBy(*within)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = stored(
        runs.select(
            *within,
            "_part",
            (
                F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
            ).alias("_shift"),
        ),
        "shifts",
    )
    # Two file scans of known size: the optimizer broadcasts the shifts where they are
    # small enough and joins by key where they are not.
    match = placed["_part"] == shifts["_part"]
    for column in within:
        match = match & placed[column].eqNullSafe(shifts[column])
    return placed.join(shifts, match).select(
        *[placed[column] for column in df.columns],
        (F.col("_slot") + F.col("_shift")).alias(name),
    )


def assign_positions(
    tiles: DataFrame, stable_key: Sequence[str], rows_per_task: int = ROWS_PER_PARTITION
) -> DataFrame:
    """Give tiles that arrive without a position their 0-based ``tile_index``.

    Rows are counted first; the sort gets a partition per ``rows_per_task`` of them, or
    the session's own number if that is larger.
    """
    own = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-tiles.count() // rows_per_task)
    numbered = number_rows(
        tiles,
        [F.col(key) for key in stable_key],
        "_place",
        partitions=wanted if wanted > own else None,
    )
    return numbered.withColumn("tile_index", F.col("_place") - 1).drop("_place")
