"""Readers and writers: files in, checked tables out; rankings back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import cameras_schema, conform, mask_schema, tiles_schema


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "json":
        # Text formats carry no types: state them instead of inferring over the data.
        reader = reader.schema(schema)
    return conform(reader.load(path), schema)


def read_tiles(
    spark: SparkSession, path: str, precision: str = "double", fmt: str = "parquet"
) -> DataFrame:
    return _read(spark, path, tiles_schema(precision), fmt)


def read_cameras(
    spark: SparkSession, path: str, precision: str = "double", fmt: str = "parquet"
) -> DataFrame:
    return _read(spark, path, cameras_schema(precision), fmt)


def read_mask(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, mask_schema(), fmt)


def write_ranking(
    ranking: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet"
) -> None:
    """Write a ranking as it comes.

    Rows leave the ranking grouped by camera and in rank order, so no shuffle is
    added and a reader asking for one camera skips most row groups.
    """
    ranking.write.format(fmt).mode(mode).save(path)


def save_mask_by_camera(mask: DataFrame, table: str, buckets: int, mode: str = "error") -> None:
    """Save a mask bucketed by camera: rankings over it need no shuffle of the pairs."""
    (
        conform(mask, mask_schema())
        .write.format("parquet")
        .mode(mode)
        .bucketBy(buckets, "camera_uid")
        .sortBy("camera_uid")
        .saveAsTable(table)
    )


def preview(ranking: DataFrame, camera_uid: int, rows: int = 20) -> DataFrame:
    """The head of one camera's ranking, for printing. ``rank`` is dense: a filter does."""
    return ranking.where((F.col("camera_uid") == camera_uid) & (F.col("rank") <= rows))
