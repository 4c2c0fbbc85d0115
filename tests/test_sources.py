import numpy as np
import pytest
from pyspark.sql import functions as F

from scenes import cameras_frame, dense_mask, random_boxes, tiles_frame
from tilerank import rank_trajectory
from tilerank.schemas import cameras_schema, conform, tiles_schema
from tilerank.sources import (
    preview,
    read_cameras,
    read_mask,
    read_tiles,
    write_ranking,
)


def _scene(spark, precision="double"):
    low, high = random_boxes(12, 1)
    visible = np.random.default_rng(2).random((3, 12)) < 0.5
    return (
        tiles_frame(spark, low, high, precision),
        cameras_frame(spark, random_boxes(3, 4)[0], precision),
        dense_mask(spark, visible),
    )


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_round_trip(spark, folder, fmt):
    tiles, cameras, mask = _scene(spark)
    for name, df in (("tiles", tiles), ("cameras", cameras), ("mask", mask)):
        df.write.format(fmt).save(f"{folder}/{name}")
    ranking = rank_trajectory(
        read_tiles(spark, f"{folder}/tiles", fmt=fmt),
        read_cameras(spark, f"{folder}/cameras", fmt=fmt),
        read_mask(spark, f"{folder}/mask", fmt=fmt),
    )
    assert ranking.exceptAll(rank_trajectory(tiles, cameras, mask)).count() == 0
    write_ranking(ranking, f"{folder}/ranking", fmt=fmt)
    back = spark.read.schema(ranking.schema).format(fmt).load(f"{folder}/ranking")
    assert back.exceptAll(ranking).count() == 0 and back.count() == 3 * 12 * 3


def test_written_cameras_are_whole_and_sorted(spark, folder):
    write_ranking(rank_trajectory(*_scene(spark)), f"{folder}/ranking")
    back = spark.read.parquet(f"{folder}/ranking")
    files = back.select("camera_uid", F.input_file_name().alias("file")).distinct()
    assert files.count() == 3
    head = preview(back, 51, 5).select("rank").collect()
    assert [r["rank"] for r in head] == [1, 2, 3, 4, 5]


def test_stored_floats_can_be_read_as_doubles_and_back(spark, folder):
    tiles, _, _ = _scene(spark, "float")
    tiles.write.parquet(f"{folder}/tiles")
    wide = read_tiles(spark, f"{folder}/tiles")
    assert wide.schema["min_corner"].dataType.simpleString() == "struct<x:double,y:double,z:double>"
    wide.write.parquet(f"{folder}/wide")
    again = read_tiles(spark, f"{folder}/wide", "float")
    assert again.exceptAll(tiles).count() == 0


def test_conform_matches_axes_by_name(spark):
    df = spark.sql(
        "SELECT 1 AS camera_uid, 2S AS camera_ord, "
        "named_struct('z', 3.0, 'y', 2.0, 'x', 1) AS camera_center, 'more' AS other"
    )
    got = conform(df, cameras_schema())
    assert got.dtypes == [
        ("camera_uid", "bigint"),
        ("camera_ord", "bigint"),
        ("camera_center", "struct<x:double,y:double,z:double>"),
    ]
    assert tuple(got.first().camera_center) == (1.0, 2.0, 3.0)


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda df: df.drop("tile_idx"), "tile_idx is missing"),
        (lambda df: df.withColumn("tile_idx", F.lit("a")), "tile_idx is string"),
        (lambda df: df.withColumn("tile_index", F.lit(0.5)), "tile_index is"),
        (
            lambda df: df.withColumn("min_corner", F.struct(F.lit(1.0).alias("x"))),
            "min_corner is struct",
        ),
    ],
)
def test_wrong_tables_are_refused(spark, change, message):
    tiles, cameras, mask = _scene(spark)
    with pytest.raises(ValueError, match=message):
        conform(change(tiles), tiles_schema())
    with pytest.raises(ValueError, match=message):
        rank_trajectory(change(tiles), cameras, mask)


def test_precision_is_checked(spark):
    with pytest.raises(ValueError, match="precision"):
        rank_trajectory(*_scene(spark), precision="half")
