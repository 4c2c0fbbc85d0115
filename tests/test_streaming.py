import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

import __spark_entry__ as driver
from tilerank import rank_trajectory
from tilerank.sources import derived
from tilerank.sources.workspace import checkpoint_folder
from tilerank.streaming import rank_announced_cameras, read_current_rankings


def test_cameras_are_ranked_as_they_are_announced(spark, sf_dir, folder):
    tiles = derived.part_tiles(spark, sf_dir)
    cameras = derived.supplier_cameras(spark, sf_dir)
    mask = derived.lineitem_mask(spark, sf_dir)
    whole = rank_trajectory(tiles, cameras, mask).cache()
    inbox, output = f"{folder}/inbox", f"{folder}/output"

    def announce(*uids):
        frame = spark.createDataFrame([(u,) for u in uids], "camera_uid bigint")
        frame.coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream = (
            spark.readStream.schema("camera_uid bigint")
            .option("maxFilesPerTrigger", 1)
            .parquet(inbox)
        )
        query = rank_announced_cameras(
            stream, tiles, cameras, mask, output, f"{folder}/checkpoint"
        )
        query.awaitTermination()
        assert query.exception() is None
        return spark.read.parquet(output)

    announce(1, 4)
    announce(7, 7)
    found = run()
    assert found.select("batch_id").distinct().count() == 2
    expected = whole.where(F.col("camera_uid").isin(1, 4, 7))
    assert found.drop("batch_id").exceptAll(expected).count() == 0
    assert found.count() == expected.count() > 0

    # Started again: only what is new is ranked.
    announce(2)
    found = run()
    expected = whole.where(F.col("camera_uid").isin(1, 2, 4, 7))
    assert found.drop("batch_id").exceptAll(expected).count() == 0
    assert found.count() == expected.count()

    # Announced again: the latest ranking is the one that counts.
    announce(2, 4)
    assert run().count() > expected.count()
    found = read_current_rankings(spark, output)
    assert found.exceptAll(expected).count() == 0 and found.count() == expected.count()


def test_what_batches_write_on_the_way_is_removed(spark, sf_dir, folder):
    shared = urlparse(checkpoint_folder(spark)).path
    before = set(os.listdir(shared))
    uids = [(1,), (4,), (None,), (7,), (None,), (2,)]
    for number, uid in enumerate(uids):
        spark.createDataFrame([uid], "camera_uid bigint").coalesce(1).write.parquet(f"{folder}/inbox/{number}")
    stream = (
        spark.readStream.schema("camera_uid bigint")
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(f"{folder}/inbox")
    )
    scene = (derived.part_tiles(spark, sf_dir), derived.supplier_cameras(spark, sf_dir), derived.lineitem_mask(spark, sf_dir))
    query = rank_announced_cameras(
        stream, *scene, f"{folder}/output", f"{folder}/checkpoint", pairs_per_task=50
    )
    query.awaitTermination()
    assert query.exception() is None
    assert len(os.listdir(f"{folder}/output")) >= len(uids)
    # Cameras above 50 pairs take the way over written tables, and none of these is left.
    assert set(os.listdir(shared)) == before
    found = read_current_rankings(spark, f"{folder}/output")
    assert {r[0] for r in found.select("camera_uid").distinct().collect()} == {1, 2, 4, 7}


def test_registered_stream_covers_all_cameras(spark, sf_dir):
    found = driver.queries()["streamed_ranking"](spark, sf_dir)
    whole = driver.queries()["trajectory_ranking"](spark, sf_dir)
    assert found.exceptAll(whole).count() == 0 and found.count() == whole.count()


def test_current_rankings_are_not_shuffled(spark, sf_dir, folder):
    """Cameras are few beside what is ranked for them, and the optimizer knows that."""
    ranking = driver.queries()["trajectory_ranking"](spark, sf_dir)
    for batch in range(2):
        ranking.write.parquet(f"{folder}/ranking/batch_id={batch}")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "16KB")
    try:
        found = read_current_rankings(spark, f"{folder}/ranking")
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(threshold)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert found.exceptAll(ranking).count() == 0 and found.count() == ranking.count()
