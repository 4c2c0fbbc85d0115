import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scenes import (
    PAIRS,
    WORKED_RANKING,
    brute_distance,
    brute_force,
    cameras_frame,
    dense_mask,
    random_boxes,
    tiles_frame,
    worked_pairs,
)
from tilerank import rank_first_camera, rank_trajectory, rank_utilities
from tilerank.operators import ranked_pairs
from tilerank.plans.utility import rank_heavy
from tilerank.sources import stored

LEVELS = 3


def rows(ranking, *columns):
    return [tuple(r) for r in ranking.orderBy("camera_uid", "rank").select(*columns).collect()]


@pytest.fixture(scope="module")
def scene(spark):
    """20 cameras over 150 lattice tiles; every pair in the mask, two cameras blind."""
    low, high = random_boxes(150, 1, lattice=True)
    centers = random_boxes(20, 2, lattice=True)[0]
    visible = np.random.default_rng(3).random((20, 150)) < 0.4
    visible[[4, 9]] = False
    return low, high, centers, visible


@pytest.fixture(scope="module")
def tables(spark, scene):
    low, high, centers, visible = scene
    return (
        tiles_frame(spark, low, high),
        cameras_frame(spark, centers),
        dense_mask(spark, visible),
    )


@pytest.fixture(scope="module")
def ranking(tables):
    return rank_trajectory(*tables, LEVELS).cache()


@pytest.mark.parametrize("precision", ["double", "float"])
@pytest.mark.parametrize("pairs_per_task", [100, 0])
def test_worked_example(spark, precision, pairs_per_task):
    got = rank_utilities(
        worked_pairs(spark), LEVELS, precision=precision, pairs_per_task=pairs_per_task
    )
    found = rows(got, "rank", "tile_index", "lod_level", F.col("utility").cast("double"))
    assert [r[:3] for r in found] == [r[:3] for r in WORKED_RANKING]
    # The table has six places; 32 bits have some seven digits.
    digits = {"double": 0.0, "float": 2e-7}[precision]
    for mine, theirs in zip(found, WORKED_RANKING):
        assert mine[3] == pytest.approx(theirs[3], rel=digits, abs=6e-7)


def test_types(ranking):
    types = dict(ranking.dtypes)
    for name in ("camera_uid", "rank", "tile_index", "tile_idx", "lod_level"):
        assert types[name] == "bigint"
    assert types["utility"] == "double"


def test_equals_brute_force(ranking, scene):
    low, high, centers, visible = scene
    found = ranking.toPandas().sort_values(["camera_uid", "rank"])
    tied = 0
    for i, center in enumerate(centers):
        order, flat = brute_force(visible[i], brute_distance(low, high, center), LEVELS)
        mine = found[found.camera_uid == 50 + i]
        assert list(zip(mine.tile_index, mine.lod_level)) == order
        assert (mine.utility.to_numpy() == flat).all()
        tied += len(flat) - len(np.unique(flat))
    assert tied > 3000


def test_float_equals_32_bit_arithmetic(spark, scene):
    low, high, centers, visible = scene
    got = rank_trajectory(
        tiles_frame(spark, low, high, "float"),
        cameras_frame(spark, centers, "float"),
        dense_mask(spark, visible),
        LEVELS,
        precision="float",
    )
    assert dict(got.dtypes)["utility"] == "float"
    found = got.toPandas().sort_values(["camera_uid", "rank"])
    for i, center in enumerate(centers):
        distance = brute_distance(low, high, center, "float32")
        order, flat = brute_force(visible[i], distance, LEVELS, "float32")
        mine = found[found.camera_uid == 50 + i]
        assert list(zip(mine.tile_index, mine.lod_level)) == order
        assert (mine.utility.to_numpy() == flat).all()


def test_whole_and_dense(ranking):
    per_camera = ranking.groupBy("camera_uid").agg(
        F.count("*").alias("n"),
        F.countDistinct("tile_index", "lod_level").alias("pairs"),
        F.min("rank").alias("lo"),
        F.max("rank").alias("hi"),
        F.countDistinct("rank").alias("ranks"),
    )
    found = per_camera.collect()
    assert len(found) == 20
    for r in found:
        assert (r.n, r.pairs, r.lo, r.hi, r.ranks) == (450, 450, 1, 450, 450)


def test_utility_never_rises(ranking):
    found = ranking.toPandas().sort_values(["camera_uid", "rank"])
    for _, camera in found.groupby("camera_uid"):
        assert (np.diff(camera.utility) <= 0).all()


def test_levels_of_a_tile_come_in_order(ranking):
    found = ranking.toPandas().sort_values(["camera_uid", "tile_index", "lod_level"])
    ranks = found["rank"].to_numpy().reshape(-1, LEVELS)
    assert (np.diff(ranks, axis=1) > 0).all()


@pytest.mark.parametrize("tile", [3, 77, 140])
def test_becoming_visible_never_lowers(tables, ranking, tile):
    tiles, cameras, mask = tables
    shown = mask.withColumn("visible", F.col("visible") | (F.col("tile_index") == tile))
    after = rank_trajectory(tiles, cameras, shown, LEVELS)
    key = ["camera_uid", "tile_index", "lod_level"]
    both = (
        ranking.where(F.col("tile_index") == tile)
        .select(*key, F.col("rank").alias("before"))
        .join(after.select(*key, F.col("rank").alias("after")), key)
    )
    assert both.count() == 60
    assert both.where("after > before").count() == 0
    assert both.where("after < before").count() > 0


@pytest.mark.parametrize("pairs_per_task", [20, 149])
def test_many_tasks_give_the_same_ranks(tables, ranking, pairs_per_task):
    wide = rank_trajectory(*tables, LEVELS, pairs_per_task=pairs_per_task)
    assert wide.exceptAll(ranking).count() == 0
    assert wide.count() == ranking.count()


@pytest.mark.parametrize("pairs_per_task", [40, 10_000])
def test_input_order_and_partitions_do_not_matter(tables, ranking, pairs_per_task):
    tiles, cameras, mask = tables
    mixed = rank_trajectory(
        tiles.repartition(5),
        cameras.orderBy(F.xxhash64("camera_uid")),
        mask.repartition(13, F.xxhash64("tile_index", "camera_uid") % 5),
        LEVELS,
        pairs_per_task=pairs_per_task,
    )
    assert mixed.exceptAll(ranking).count() == 0 and mixed.count() == ranking.count()


def test_cameras_sharing_a_place(tables):
    tiles, cameras, mask = tables
    tied = cameras.withColumn("camera_ord", F.lit(0).cast("bigint"))
    got = rank_first_camera(tiles, tied, mask, LEVELS)
    assert {r.camera_uid for r in got.select("camera_uid").distinct().collect()} == {50}
    expected = rank_trajectory(tiles, tied, mask.where("camera_uid = 50"), LEVELS)
    assert got.exceptAll(expected).count() == 0 and got.count() == 450


def _hot_pairs(spark):
    """One camera with 1,200 of 3,600 pairs, at one distance and so all tied."""
    return spark.range(3600).select(
        F.when(F.col("id") < 1200, -1).otherwise(F.col("id") % 40).cast("bigint").alias("camera_uid"),
        F.col("id").alias("tile_index"),
        (F.col("id") % 3 == 0).alias("visible"),
        F.when(F.col("id") < 1200, 2.0).otherwise(F.col("id") % 7).cast("double").alias("distance"),
    )


def test_hot_camera_is_spread_and_ranked_the_same(spark, monkeypatch):
    pairs = _hot_pairs(spark)
    narrow = rank_utilities(pairs, LEVELS)
    split = rank_utilities(pairs, LEVELS, pairs_per_task=200)
    assert split.count() == 3600 * LEVELS
    assert split.exceptAll(narrow).count() == 0

    written = []

    def spy(df, name):
        written.append(stored(df, name))
        return written[-1]

    monkeypatch.setattr("tilerank.operators.numbering.stored", spy)
    wide = rank_heavy(pairs.where("camera_uid = -1"), LEVELS, partitions=16)
    assert wide.exceptAll(narrow).count() == 0
    # Each task writes one file. None holds more than a fraction of the one camera.
    per_task = written[0].groupBy(F.input_file_name()).count().collect()
    sizes = [r["count"] for r in per_task]
    assert sum(sizes) == 3600 and len(sizes) > 8 and max(sizes) < 900


def test_sizes_may_be_upper_bounds(spark):
    pairs = _hot_pairs(spark)
    bounds = pairs.groupBy("camera_uid").agg((F.count("*") * 3).alias("pairs"))
    got = rank_utilities(pairs, LEVELS, pairs_per_task=200, camera_sizes=bounds)
    assert got.exceptAll(rank_utilities(pairs, LEVELS)).count() == 0
    assert got.count() == 3600 * LEVELS


def test_first_camera_ranks_every_tile(tables, scene):
    tiles, cameras, mask = tables
    low, high, centers, visible = scene
    got = rank_first_camera(tiles, cameras, mask.where("visible"), LEVELS)
    last = len(centers) - 1  # camera_ord falls as the id rises
    order, _ = brute_force(visible[last], brute_distance(low, high, centers[last]), LEVELS)
    assert rows(ranked_pairs(got), "camera_uid", "tile_index", "lod_level") == [
        (50 + last, tile, level) for tile, level in order
    ]
    wide = rank_first_camera(tiles, cameras, mask, LEVELS, pairs_per_task=20)
    assert wide.exceptAll(got).count() == 0 and wide.count() == 450


def test_sizes_may_leave_cameras_out(spark):
    pairs = _hot_pairs(spark)
    some = pairs.where("camera_uid = -1").groupBy("camera_uid").agg(F.count("*").alias("pairs"))
    got = rank_utilities(pairs, LEVELS, pairs_per_task=200, camera_sizes=some)
    assert got.exceptAll(rank_utilities(pairs, LEVELS)).count() == 0
    assert got.count() == 3600 * LEVELS


def _pair(spark, *rows_):
    return spark.createDataFrame(list(rows_), PAIRS)


def test_distance_zero(spark):
    got = rank_utilities(_pair(spark, (1, 0, True, 0.0)), 1)
    assert rows(got, "rank", "lod_level", "utility") == [(1, 0, 1.0 / 0.001)]


@pytest.mark.parametrize("pairs_per_task", [100, 1])
def test_rows_without_a_camera_stay(spark, pairs_per_task):
    pairs = _pair(
        spark, (None, 0, True, 1.0), (None, 1, True, 2.0), (3, 0, True, 1.0), (3, 1, True, 2.0)
    )
    got = rank_utilities(pairs, 1, pairs_per_task=pairs_per_task)
    assert rows(got, "camera_uid", "rank", "tile_index") == [
        (None, 1, 0), (None, 2, 1), (3, 1, 0), (3, 2, 1)
    ]


def test_null_visibility_counts_as_hidden(spark):
    got = rank_utilities(_pair(spark, (1, 0, None, 1.0), (1, 1, False, 1.0)), 1)
    (a,), (b,) = rows(got, "utility")
    assert a == b == 0.01 * (1.0 / 1.001)


@pytest.mark.parametrize("pairs_per_task", [100, 0])
def test_nan_first_null_last(spark, pairs_per_task):
    pairs = _pair(spark, (1, 0, True, None), (1, 1, True, 0.5), (1, 2, True, math.nan))
    got = rank_utilities(pairs, 1, pairs_per_task=pairs_per_task)
    assert rows(got, "tile_index") == [(2,), (1,), (0,)]


@pytest.mark.parametrize("precision", ["double", "float"])
def test_negative_distance_is_an_error(spark, precision):
    got = rank_utilities(_pair(spark, (1, 0, True, -0.001)), 1, precision=precision)
    with pytest.raises(PySparkException, match="negative distance"):
        got.collect()


@pytest.mark.parametrize("levels", [0, -1, 2.0, True, None])
def test_levels_are_checked(spark, levels):
    with pytest.raises(ValueError, match="num_levels"):
        rank_utilities(worked_pairs(spark), levels)


def test_one_level(spark):
    got = rank_utilities(worked_pairs(spark), 1)
    assert rows(got, "tile_index", "lod_level") == [(0, 0), (2, 0), (1, 0)]


def test_nothing_to_rank(tables):
    tiles, cameras, mask = tables
    assert rank_trajectory(tiles.where("false"), cameras, mask, LEVELS, unknown="drop").count() == 0
    with pytest.raises(PySparkException, match="not known"):
        rank_trajectory(tiles.where("false"), cameras, mask, LEVELS).count()
    assert rank_trajectory(tiles, cameras.where("false"), mask, LEVELS, unknown="drop").count() == 0
    assert rank_trajectory(tiles, cameras, mask.where("false"), LEVELS).count() == 0
    assert rank_first_camera(tiles, cameras.where("false"), mask, LEVELS).count() == 0
    assert rank_first_camera(tiles.where("false"), cameras, mask, LEVELS).count() == 0
    assert rank_heavy(_hot_pairs(tiles.sparkSession).where("false"), LEVELS).count() == 0


pair_lists = st.lists(
    st.tuples(
        st.integers(0, 3),
        st.integers(0, 30),
        st.booleans(),
        st.sampled_from([0.0, 0.5, 1.0, 1.0, 3.25, 1e6]) | st.floats(0, 1e3),
    ),
    max_size=40,
    unique_by=lambda row: row[:2],
)


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(pair_lists, st.integers(1, 5), st.sampled_from([1, 10, 1000]))
def test_any_pairs_equal_brute_force(spark, pairs, levels, pairs_per_task):
    got = rank_utilities(
        spark.createDataFrame(pairs, PAIRS), levels, pairs_per_task=pairs_per_task
    )
    found = rows(got, "camera_uid", "rank", "tile_index", "lod_level")
    expected = []
    for camera in sorted({row[0] for row in pairs}):
        mine = sorted(row for row in pairs if row[0] == camera)
        order, _ = brute_force(
            np.array([row[2] for row in mine]), np.array([row[3] for row in mine]), levels
        )
        expected += [
            (camera, rank, mine[place][1], level)
            for rank, (place, level) in enumerate(order, 1)
        ]
    assert found == expected
