"""Tables written on the way to a result, in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set as checkpoint directory. The
    session must name one, as a machine's own disk goes away with the machine."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    return folder


# The folder of the innermost workspace, if any.
_current: ContextVar[str | None] = ContextVar("workspace", default=None)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Own the tables written on the way: they go to one folder, removed at the end.

    Results are computed when they are asked for, so write them before leaving.
    """
    folder = f"{checkpoint_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _current.set(folder)
    try:
        yield folder
    finally:
        _current.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = _current.get() or checkpoint_folder(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: evaluated once, and safe from executor loss.

    Being a file scan, the result also tells the optimizer its true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
