"""What the optimizer makes of the jobs."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from scenes import PAIRS
from tilerank import rank_first_camera, rank_trajectory, rank_utilities
from tilerank.sources import derived, save_mask_by_camera


def plan(df, run=False):
    execution = df._jdf.queryExecution()
    if run:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return execution.executedPlan().toString()


def executed_plans(spark, query):
    """The plan of what ``query`` returns, and of all that ran while it was made."""

    def executions():
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {found.apply(i).executionId(): found.apply(i) for i in range(found.size())}

    before = set(executions())
    last = plan(query())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = [e.physicalPlanDescription() for key, e in sorted(executions().items()) if key not in before]
    return [*ran, last]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def stored_mask(spark, sf_dir):
    path = tempfile.mkdtemp(prefix="spark-test-") + "/mask"
    derived.lineitem_mask(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


# Queries that run most of their work before they return.
EAGER = {"ranking_large_camera", "ranking_split_cameras", "ranking_from_files", "streamed_ranking"}


@pytest.mark.parametrize("name", sorted(driver.tile_queries()))
def test_no_query_pairs_rows_without_a_key(spark, sf_dir, name, no_broadcast):
    texts = executed_plans(spark, lambda: driver.queries()[name](spark, sf_dir))
    if name in EAGER:
        assert len(texts) > 1 and any("Join" in text for text in texts[:-1])
    for text in texts:
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_one_shuffle_of_the_mask_when_lookups_are_small(spark, sf_dir, stored_mask):
    text = plan(
        rank_trajectory(
            derived.part_tiles(spark, sf_dir),
            derived.supplier_cameras(spark, sf_dir),
            stored_mask,
        )
    )
    assert text.count("Exchange hashpartitioning") == 1
    # It comes before the levels: one row per pair, not one per pair and level.
    assert text.index("Generate") < text.index("Exchange hashpartitioning")


def test_large_lookups_shuffle_by_tile_then_by_camera(
    spark, sf_dir, stored_mask, no_broadcast
):
    text = plan(
        rank_trajectory(
            derived.part_tiles(spark, sf_dir),
            derived.supplier_cameras(spark, sf_dir),
            stored_mask,
        )
    )
    assert text.count("SortMergeJoin") == 2
    # Each side of each join once; the window finds its rows in place.
    assert text.count("Exchange hashpartitioning") == 4


def test_one_shuffle_by_camera_at_any_number_of_partitions(
    spark, sf_dir, stored_mask, no_broadcast
):
    text = plan(
        rank_trajectory(
            derived.part_tiles(spark, sf_dir),
            derived.supplier_cameras(spark, sf_dir),
            stored_mask,
            pairs_per_task=10_000,
            camera_sizes=stored_mask.groupBy("camera_uid").agg(F.lit(9_000).alias("pairs")),
        )
    )
    wanted = re.findall(r"hashpartitioning\(camera_uid#\d+L?, (\d+)\)", text)
    # One for the pairs, one for the cameras, and both as many as the pairs ask for.
    assert len(wanted) == 2 and len(set(wanted)) == 1 and int(wanted[0]) > 8
    assert text.count("Exchange hashpartitioning") == 4


def test_heavy_cameras_do_not_depend_on_broadcasts(
    spark, sf_dir, stored_mask, no_broadcast
):
    tiles = derived.part_tiles(spark, sf_dir)
    cameras = derived.supplier_cameras(spark, sf_dir)
    whole = rank_trajectory(tiles, cameras, stored_mask)
    sizes = stored_mask.groupBy("camera_uid").count()
    middle = int(sizes.agg(F.median("count")).first()[0])
    split = rank_trajectory(tiles, cameras, stored_mask, pairs_per_task=middle)
    text = plan(split)
    assert "Union" in text and "Broadcast" not in text
    assert split.exceptAll(whole).count() == 0 and split.count() == whole.count()


def test_bucketed_mask_is_not_shuffled(spark, sf_dir, stored_mask):
    save_mask_by_camera(stored_mask, "mask_by_camera", 4, mode="overwrite")
    mask = spark.table("mask_by_camera")
    tiles = derived.part_tiles(spark, sf_dir)
    cameras = derived.supplier_cameras(spark, sf_dir)
    ranking = rank_trajectory(tiles, cameras, mask, gathered=True)
    assert "Exchange hashpartitioning" not in plan(ranking)
    assert ranking.exceptAll(rank_trajectory(tiles, cameras, stored_mask)).count() == 0


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(driver.queries()["ranking_pairs"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("l_linestatus" in s for s in schemas)
    for s in schemas:
        assert not re.search(r"l_tax|l_shipdate|p_brand|s_name", s)


def test_first_camera_reaches_the_scan(spark, sf_dir, stored_mask):
    text = plan(
        rank_first_camera(
            derived.part_tiles(spark, sf_dir),
            derived.supplier_cameras(spark, sf_dir),
            stored_mask,
        )
    )
    assert re.search(r"DataFilters: \[[^\]]*camera_uid#\d+L? = Subquery", text)


def test_choosing_a_camera_prunes_the_others_before_the_shuffle(spark, sf_dir, stored_mask):
    ranking = rank_trajectory(
        derived.part_tiles(spark, sf_dir),
        derived.supplier_cameras(spark, sf_dir),
        stored_mask,
    ).where("camera_uid = 3")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(camera_uid,3\)", plan(ranking))


def test_hot_tile_is_split_when_shuffled(spark, no_broadcast):
    """A third of all mask rows ask for one tile."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 3000)
        mask = spark.range(0, 60_000, numPartitions=8).select(
            F.col("id").alias("camera_uid"),
            hot.cast("bigint").alias("tile_index"),
            F.lit(True).alias("visible"),
        )
        corner = F.struct(*[F.lit(0.0).alias(a) for a in "xyz"])
        tiles = spark.range(3000).select(
            F.col("id").alias("tile_index"),
            F.col("id").alias("tile_idx"),
            corner.alias("min_corner"),
            corner.alias("max_corner"),
        )
        cameras = spark.range(60_000).select(
            F.col("id").alias("camera_uid"),
            F.col("id").alias("camera_ord"),
            corner.alias("camera_center"),
        )
        ranking = rank_trajectory(tiles, cameras, mask, 1)
        assert ranking.count() == 60_000
        done = ranking.select("camera_uid", "tile_index", "rank", "utility")
        rows = done.collect()
        assert len(rows) == 60_000
        assert "SortMergeJoin(skew=true)" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_small_inputs_need_no_table_written(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("nothing is to be written")

    monkeypatch.setattr("tilerank.operators.heavy.stored", refuse)
    monkeypatch.setattr("tilerank.operators.numbering.stored", refuse)
    pairs = spark.createDataFrame([(1, 0, True, 1.0)], PAIRS)
    assert rank_utilities(pairs).count() == 3


def test_task_numbers_follow_the_data(spark):
    pairs = spark.range(4000).select(
        (F.col("id") % 200).alias("camera_uid"),
        F.col("id").alias("tile_index"),
        F.lit(True).alias("visible"),
        F.lit(1.0).alias("distance"),
    )
    assert "hashpartitioning(camera_uid" in plan(rank_utilities(pairs))
    text = plan(rank_utilities(pairs, pairs_per_task=100))
    assert re.search(r"hashpartitioning\(camera_uid#\d+L, 40\), REPARTITION_BY_NUM", text)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(initial, "64")
    try:
        text = plan(rank_utilities(pairs, pairs_per_task=100))
        assert re.search(r"hashpartitioning\(camera_uid#\d+L, 64\), REPARTITION_BY_COL", text)
    finally:
        spark.conf.unset(initial)


@pytest.fixture
def small_partitions(monkeypatch):
    """Partitions are to hold 500 rows."""
    for module in ("operators.heavy", "sources.derived"):
        monkeypatch.setattr(f"tilerank.{module}.ROWS_PER_PARTITION", 500, raising=False)


@pytest.mark.parametrize("name", ["utility_ranking_float32", "ranking_of_repeats", "trajectory_ranking", "ranking_pairs", "utility_ranking"])
def test_cameras_are_not_merged_into_large_partitions(spark, sf_dir, name, small_partitions):
    """Also if the session has more partitions than the rows ask for."""
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(initial, "4000")
    try:
        text = plan(driver.queries()[name](spark, sf_dir))
    finally:
        spark.conf.unset(initial)
    items = derived.table(spark, sf_dir, "lineitem").count()
    wanted = re.findall(r"hashpartitioning\(camera_uid#\d+L, (\d+)\), REPARTITION_BY_NUM", text)
    assert [int(n) for n in wanted] == [-(-3 * items // 500)]


def test_a_large_mask_is_made_in_bounded_partitions(spark, sf_dir, monkeypatch, small_partitions):
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(initial, "4000")
    try:
        mask = derived.lineitem_mask(spark, sf_dir)
        text = plan(mask)
    finally:
        spark.conf.unset(initial)
    items = derived.table(spark, sf_dir, "lineitem").count()
    assert text.count("Exchange hashpartitioning") == 1
    assert re.search(
        rf"hashpartitioning\(camera_uid#\d+L, tile_index#\d+L, {-(-items // 500)}\), REPARTITION_BY_NUM", text
    )
    monkeypatch.undo()
    few = derived.lineitem_mask(spark, sf_dir)
    assert "REPARTITION_BY_NUM" not in plan(few)
    assert mask.exceptAll(few).count() == 0 and mask.count() == few.count()


def test_a_ranking_from_files_is_not_merged_into_large_partitions(spark, sf_dir, small_partitions):
    """The mask and the ranking, which are written while the query is made."""
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(initial, "4000")
    try:
        texts = executed_plans(spark, lambda: driver.queries()["ranking_from_files"](spark, sf_dir))
    finally:
        spark.conf.unset(initial)
    for keys in (r"camera_uid#\d+L, tile_index#\d+L", r"camera_uid#\d+L"):
        assert any(re.search(rf"hashpartitioning\({keys}, \d+\), REPARTITION_BY_NUM", t) for t in texts)
