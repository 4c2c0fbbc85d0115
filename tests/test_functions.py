import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tilerank import flatten_utilities, score_pairs
from tilerank.functions import flat_index, flat_level, flat_tile, level_weight
from tilerank.operators import assign_positions, expand_levels, number_rows
from scenes import worked_pairs


@pytest.mark.parametrize("levels", [1, 3, 7, 23])
def test_level_weights_are_exact_powers(spark, levels):
    got = expand_levels(spark.range(1), levels).orderBy("lod_level").collect()
    assert [(r.lod_level, r.layer_weight) for r in got] == [
        (k, 10.0 ** (levels - 1 - k)) for k in range(levels)
    ]


def test_level_weight_as_column(spark):
    got = spark.range(3).select(level_weight(F.col("id"), 3, "float").alias("w"))
    assert [r.w for r in got.collect()] == [100.0, 10.0, 1.0]


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.integers(0, 2**60 // 50), min_size=1, max_size=20), st.integers(1, 50))
def test_flat_positions_invert(spark, tile_indexes, levels):
    tiles = spark.createDataFrame([(t,) for t in tile_indexes], "tile_index bigint")
    flat = expand_levels(tiles, levels).withColumn(
        "flat", flat_index(F.col("tile_index"), F.col("lod_level"), levels)
    )
    wrong = flat.where(
        (flat_tile(F.col("flat"), levels) != F.col("tile_index"))
        | (flat_level(F.col("flat"), levels) != F.col("lod_level"))
    )
    assert wrong.count() == 0


def test_flat_index_is_row_major(spark):
    got = flatten_utilities(score_pairs(worked_pairs(spark)), 3).orderBy("flat_index")
    assert [(r.flat_index, r.tile_index, r.lod_level) for r in got.collect()] == [
        (i, i // 3, i % 3) for i in range(9)
    ]


def test_row_numbers_cross_partitions(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("g"), F.lit(1).alias("tied"), F.xxhash64("id").alias("v")
    )
    got = number_rows(df, ["tied", F.desc("v")], "place", within=["g"], partitions=13)
    found = got.toPandas().sort_values(["g", "place"])
    for _, group in found.groupby("g"):
        assert list(group.place) == list(range(1, len(group) + 1))
        assert list(group.v) == sorted(group.v, reverse=True)
    assert len(found) == 5000


def test_row_numbers_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (5, 2)], "g bigint, v bigint")
    got = number_rows(df, ["v"], "place", within=["g"])
    assert {tuple(r) for r in got.collect()} == {(None, 1, 1), (None, 3, 2), (5, 2, 1)}


def test_positions_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("label")).repartition(6)
    got = assign_positions(df, ["label"])
    assert got.where("tile_index <> label").count() == 0
    assert got.count() == 1000
