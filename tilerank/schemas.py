"""Table layouts, and a check that needs no Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

PRECISIONS = ("double", "float")


def point_type(precision: str = "double") -> T.StructType:
    axis_type = {"double": T.DoubleType(), "float": T.FloatType()}[checked_precision(precision)]
    return T.StructType([T.StructField(axis, axis_type) for axis in "xyz"])


def tiles_schema(precision: str = "double") -> T.StructType:
    return T.StructType(
        [
            T.StructField("tile_index", T.LongType()),
            T.StructField("tile_idx", T.LongType()),
            T.StructField("min_corner", point_type(precision)),
            T.StructField("max_corner", point_type(precision)),
        ]
    )


def cameras_schema(precision: str = "double") -> T.StructType:
    return T.StructType(
        [
            T.StructField("camera_uid", T.LongType()),
            T.StructField("camera_ord", T.LongType()),
            T.StructField("camera_center", point_type(precision)),
        ]
    )


def mask_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("camera_uid", T.LongType()),
            T.StructField("tile_index", T.LongType()),
            T.StructField("visible", T.BooleanType()),
        ]
    )


def checked_precision(precision: str) -> str:
    if precision not in PRECISIONS:
        raise ValueError(f"precision must be one of {PRECISIONS}, not {precision!r}")
    return precision


def checked_levels(num_levels: int) -> int:
    if isinstance(num_levels, bool) or not isinstance(num_levels, int) or num_levels < 1:
        raise ValueError(f"num_levels must be an integer of at least 1, not {num_levels!r}")
    return num_levels


def _fits(found: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(wanted, T.StructType):
        return isinstance(found, T.StructType) and all(
            field.name in found.names and _fits(found[field.name].dataType, field.dataType)
            for field in wanted
        )
    if isinstance(wanted, (T.DoubleType, T.FloatType)):
        return isinstance(found, T.NumericType)
    if isinstance(wanted, T.LongType):
        return isinstance(found, T.IntegralType)
    return found == wanted


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: named columns only, cast to the stated types."""
    given = df.schema
    if given.simpleString() == schema.simpleString():
        return df
    for field in schema:
        if field.name not in given.names:
            raise ValueError(f"column {field.name} is missing; found {given.names}")
        found = given[field.name].dataType
        if not _fits(found, field.dataType):
            raise ValueError(
                f"column {field.name} is {found.simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )

    def projected(field: T.StructField):
        if not isinstance(field.dataType, T.StructType):
            return F.col(field.name).cast(field.dataType).alias(field.name)
        # By name: a struct cast would match axes by position.
        axes = [
            F.col(f"{field.name}.{axis.name}").cast(axis.dataType).alias(axis.name)
            for axis in field.dataType
        ]
        return F.struct(*axes).alias(field.name)

    return df.select(*[projected(field) for field in schema])
