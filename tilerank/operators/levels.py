"""One row per level of detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import level_weight
from ..schemas import checked_levels


def expand_levels(df: DataFrame, num_levels: int, precision: str = "double") -> DataFrame:
    """Repeat each row for ``lod_level`` 0..num_levels-1, with its ``layer_weight``.

    Levels and weights depend on no row: the optimizer folds them into one literal.
    """
    checked_levels(num_levels)
    levels = F.array(
        *[
            F.struct(
                F.lit(level).cast("bigint").alias("lod_level"),
                level_weight(F.lit(level), num_levels, precision).alias("layer_weight"),
            )
            for level in range(num_levels)
        ]
    )
    return df.select("*", F.inline(levels))
