"""Scenes made from the given star-schema tables, always from every row of them.

Warehouse scene: parts are tiles, suppliers are cameras, and each line item is one
sighting of a part by a supplier. Coordinates lie on a lattice, so that equal
distances, and with them tied scores, are common.

Embedding scene: every vector is a tile and a camera, with continuous coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import ROWS_PER_PARTITION
from ..functions import box_center, point
from ..operators.heavy import partitions_for
from ..schemas import cameras_schema, conform, mask_schema, tiles_schema


# The columns used here, stated so that no job has to look them up.
_COLUMNS = {
    "part": "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "lineitem": "l_partkey bigint, l_suppkey bigint, l_linestatus string",
    "embeddings": "vec_id bigint, embedding array<float>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def part_tiles(spark: SparkSession, sf_dir: str, precision: str = "double") -> DataFrame:
    corner_x = F.col("p_size") / 8
    corner_y = F.floor("p_retailprice").cast("double") / 8
    corner_z = F.length("p_name") / 8
    depth = F.length("p_type") / 8
    tiles = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("tile_index"),
        (F.col("p_partkey") + 1000).alias("tile_idx"),
        point(corner_x, corner_y, corner_z).alias("min_corner"),
        point(corner_x + 0.5, corner_y + 0.25, corner_z + depth).alias("max_corner"),
    )
    return conform(tiles, tiles_schema(precision))


def supplier_cameras(spark: SparkSession, sf_dir: str, precision: str = "double") -> DataFrame:
    """The trajectory visits suppliers from the last key down to the first."""
    cameras = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("camera_uid"),
        (-F.col("s_suppkey")).alias("camera_ord"),
        point(
            F.col("s_nationkey") / 4,
            F.floor("s_acctbal").cast("double") / 64,
            F.col("s_nationkey") / 8,
        ).alias("camera_center"),
    )
    return conform(cameras, cameras_schema(precision))


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("camera_uid"),
        F.col("l_partkey").alias("tile_index"),
        (F.col("l_linestatus") == "O").alias("open"),
    )


def lineitem_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (supplier, part): visible if any of their line items is open.

    Files know how many rows they have. Many line items are dealt out by pair first, in
    partitions of bounded numbers of rows: repeats are rare, so that merging them before
    the shuffle as well would take memory and save none of it.
    """
    items = _line_items(spark, sf_dir)
    partitions = partitions_for(items, items.count(), ROWS_PER_PARTITION)
    if partitions:
        items = items.repartition(partitions, "camera_uid", "tile_index")
    mask = (
        items.groupBy("camera_uid", "tile_index")
        .agg(F.bool_or("open").alias("visible"))
    )
    return conform(mask, mask_schema())


def lineitem_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask with its repeats in: a row per line item, visible if that one is open."""
    return conform(_line_items(spark, sf_dir).withColumnRenamed("open", "visible"), mask_schema())


def lineitem_camera_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most this many pairs per supplier: its line items, before repeats are merged."""
    return _line_items(spark, sf_dir).groupBy("camera_uid").agg(
        F.count(F.lit(1)).alias("pairs")
    )


def lineitem_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (supplier, part) pairs alone."""
    return _line_items(spark, sf_dir).select("camera_uid", "tile_index").distinct()


def lineitem_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the pairs that are visible, as often as they were seen."""
    return _line_items(spark, sf_dir).where("open").select("camera_uid", "tile_index")


def _component(position: int) -> Column:
    return F.col("embedding")[position].cast("double")


def embedding_tiles(spark: SparkSession, sf_dir: str, precision: str = "double") -> DataFrame:
    pairs = [(_component(k), _component(k + 3)) for k in range(3)]
    tiles = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tile_index"),
        (F.col("vec_id") + 1000).alias("tile_idx"),
        point(*[F.least(a, b) for a, b in pairs]).alias("min_corner"),
        point(*[F.greatest(a, b) for a, b in pairs]).alias("max_corner"),
    )
    return conform(tiles, tiles_schema(precision))


def embedding_cameras(spark: SparkSession, sf_dir: str, precision: str = "double") -> DataFrame:
    cameras = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("camera_uid"),
        F.col("vec_id").alias("camera_ord"),
        point(*[_component(k) for k in range(6, 9)]).alias("camera_center"),
    )
    return conform(cameras, cameras_schema(precision))


def in_front(tile_low: Column, tile_high: Column, camera: Column) -> Column:
    """Stand-in visibility for the embedding scene: the box centre lies farther along
    the x axis than the camera."""
    return box_center(tile_low, tile_high)["x"] > camera["x"]
