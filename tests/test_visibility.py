import numpy as np
from pyspark.sql import functions as F

from scenes import dense_mask, random_boxes, tiles_frame
from tilerank.operators import label_tiles, mark_visible, visible_pages, visible_tiles


def _mask(spark):
    visible = np.random.default_rng(5).random((6, 40)) < 0.3
    visible[2] = False
    return visible, dense_mask(spark, visible)


def test_join_form_equals_column_form(spark):
    _, mask = _mask(spark)
    pairs = mask.select("camera_uid", "tile_index")
    for sightings in (visible_tiles(mask), mask):
        assert mark_visible(pairs, sightings).exceptAll(mask).count() == 0
    assert mark_visible(pairs, mask).count() == 240


def test_repeated_sightings_make_one_row(spark):
    _, mask = _mask(spark)
    often = mask.union(mask).union(mask.withColumn("visible", F.lit(False)))
    got = mark_visible(mask.select("camera_uid", "tile_index"), often)
    assert got.count() == 240 and got.exceptAll(mask).count() == 0


def test_null_in_sightings_is_not_visible(spark):
    pairs = spark.createDataFrame([(1, 0), (1, 1)], "camera_uid bigint, tile_index bigint")
    seen = spark.createDataFrame(
        [(1, 0, None)], "camera_uid bigint, tile_index bigint, visible boolean"
    )
    assert [r.visible for r in mark_visible(pairs, seen).collect()] == [False, False]


def test_pages_make_up_the_whole_list(spark):
    visible, mask = _mask(spark)
    tiles = tiles_frame(spark, *random_boxes(40, 6))
    for page_tiles in (7, 40, 4096):
        pages = visible_pages(label_tiles(mask, tiles), page_tiles).collect()
        assert max(len(r.visible_tile_idxs) for r in pages) <= page_tiles
        for camera in range(6):
            mine = sorted(
                (r for r in pages if r.camera_uid == 50 + camera), key=lambda r: r.page
            )
            labels = [label for r in mine for label in r.visible_tile_idxs]
            assert mine, "a camera that sees nothing stays"
            assert labels == [1000 + 7 * int(i) for i in np.where(visible[camera])[0]]


def test_labels_may_repeat(spark):
    tiles = tiles_frame(spark, *random_boxes(3, 6)).withColumn(
        "tile_idx", F.lit(9).cast("bigint")
    )
    mask = dense_mask(spark, np.array([[True, True, False]]))
    assert visible_pages(label_tiles(mask, tiles)).first().visible_tile_idxs == [9, 9]
