"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.workspace import stored
from .arrow import quoted

# A text that is larger than this part of the budget teaches nothing.
_LARGEST_PART = 64


def sampled_labels(labels: DataFrame, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """``doc_id`` and ``label`` of at most ``rows`` doc_ids, those with the smallest hashes:
    the same in each run, and no more for a larger table. A doc_id with several labels has the
    smallest; rows without a doc_id or label are none."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(quoted(label)).isNotNull())
    if where is not None:
        known = known.where(where)
    return (
        known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min(F.col(quoted(label)).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def sampled_texts(docs: DataFrame, sample: DataFrame, text: str, most_bytes: int) -> DataFrame:
    """``doc_id``, ``label`` and ``text`` (null: empty), one row per sampled doc_id that has a
    document: of several, the text with the smallest digest.

    Together the texts have at most ``most_bytes`` bytes in UTF-8. They are taken whole, in the
    order of the sample, while that lasts; what comes after, and any text larger than a 64th of
    it, teaches nothing. Other columns of ``docs`` play no part.
    """
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    # At most as many narrow rows as the sample has: safe to broadcast.
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("text")).join(
        F.broadcast(sample), "doc_id"
    )
    one = stored(
        found.where(F.octet_length("text") <= most_bytes // _LARGEST_PART)
        .groupBy("doc_id", "label")
        .agg(F.min(F.struct(F.md5("text").alias("digest"), "text")).alias("_first"))
        .select("doc_id", "label", F.col("_first.text").alias("text")),
        "sampled-texts",
    )
    # One narrow row per sampled doc_id.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = one.select("doc_id", F.octet_length("text").alias("_bytes"))
    fitting = sizes.withColumn("_sum", F.sum("_bytes").over(order)).where(F.col("_sum") <= most_bytes)
    return one.join(fitting.select("doc_id"), "doc_id", "left_semi")
