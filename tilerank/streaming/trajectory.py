"""Ranking cameras as they are announced, instead of a whole trajectory at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import DEFAULT_LEVELS
from ..plans.trajectory import rank_trajectory
from ..schemas import conform, mask_schema
from ..sources.workspace import stored, workspace


def rank_announced_cameras(
    announcements: DataFrame,
    tiles: DataFrame,
    cameras: DataFrame,
    mask: DataFrame,
    output: str,
    checkpoint: str,
    num_levels: int = DEFAULT_LEVELS,
    *,
    camera_sizes: DataFrame | None = None,
    **options,
) -> StreamingQuery:
    """Start ranking the cameras named by the stream ``announcements`` (``camera_uid``).

    A camera is announced once its rows are in ``mask``; an announcement that names none is
    left out, as no camera without a name has a center. A ranking needs all pairs of
    its camera, so what streams is the announcement and not the mask: a camera is always
    ranked whole. Each micro-batch replaces the folder ``batch_id=<n>`` below
    ``output``, so one that is run again after a failure leaves no repeats. A camera that
    is announced again is ranked again; ``read_current_rankings`` gives its latest ranking.
    Tables written on the way to a batch's ranking are removed once that is written.

    ``camera_sizes`` and the other options are those of ``rank_trajectory``.

    The query takes what is there and stops; start it again with the same
    ``checkpoint`` for what has come since.
    """

    def rank_batch(batch: DataFrame, batch_id: int) -> None:
        with workspace(batch.sparkSession):
            # Written, as the optimizer does not know the size of a micro-batch.
            named = batch.select("camera_uid").where(F.col("camera_uid").isNotNull()).distinct()
            wanted = stored(named, "announced")
            # The range reaches the scan: files and row groups of other cameras are skipped.
            lowest, highest = wanted.agg(F.min("camera_uid"), F.max("camera_uid")).first()

            def announced(table: DataFrame) -> DataFrame:
                in_range = F.col("camera_uid").between(F.lit(lowest), F.lit(highest))
                return table.where(in_range).join(wanted, "camera_uid", "left_semi")

            ranking = rank_trajectory(
                tiles,
                cameras,
                announced(conform(mask, mask_schema())),
                num_levels,
                camera_sizes=None if camera_sizes is None else announced(camera_sizes),
                **options,
            )
            ranking.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        announcements.writeStream.foreachBatch(rank_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_current_rankings(spark: SparkSession, output: str) -> DataFrame:
    """What ``rank_announced_cameras`` has written, each camera by its latest ranking.

    The latest batch of each camera is a small table; rows of earlier ones drop out by a
    semi join. It is written at once, so that the optimizer knows its size and shuffles
    the rankings only if it is large; batches that come later are not read.
    """
    written = spark.read.parquet(output)
    latest = stored(
        written.groupBy("camera_uid").agg(F.max("batch_id").alias("batch_id")), "latest"
    )
    return written.join(latest, ["camera_uid", "batch_id"], "left_semi").drop("batch_id")
