"""A checkpoint folder for trials and tests in a local session that names none."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def name_folder(spark: SparkSession) -> None:
    """Leave a session that names a folder alone, and any cluster: it must name its own."""
    context = spark.sparkContext
    named = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not named and context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def with_folder(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, *args):
        name_folder(spark)
        return query(spark, *args)

    return run
