"""Connected components of a table of links, without gathering any group in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.workspace import stored


class UnionFind:
    """Sets of integers, each known by its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        parent = self.parent
        root = node
        while (above := parent.get(root, root)) != root:
            root = above
        while (above := parent.get(node, node)) != root:
            parent[node], node = root, above
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = min(a, b), max(a, b)
            self.parent[high] = low
            self.parent.setdefault(low, low)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by links to the smallest node they connect to there."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        nodes = [node for node, up in sets.parent.items() if node != up]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(nodes, type=pa.int64()),
                pa.array([sets.find(node) for node in nodes], type=pa.int64()),
            ],
            names=["a", "b"],
        )


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for all nodes of ``links``.

    ``links`` has the bigint columns ``a`` and ``b``, in either direction, repeats and loops
    allowed; links with a null end are left out. Union-find first contracts what meets in one
    Arrow batch. Then, until nothing changes, each root takes the smallest label next to any
    of its nodes, and each node the label of its label. Sums of minima are pre-aggregated, so
    a node with very many links does not meet in one task; each round is a written table.
    """
    ends = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    ends = ends.where("a IS NOT NULL AND b IS NOT NULL")
    edges = stored(ends.mapInArrow(_contract, "a bigint, b bigint").distinct(), f"{name}-links")
    labels = stored(
        edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        .union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")))
        .groupBy("node")
        .agg(F.min("label").alias("label")),
        f"{name}-labels",
    )
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        # Where the ends of a link disagree, the larger label hangs itself below the smaller.
        hooks = (
            edges.join(of_a, "a")
            .join(of_b, "b")
            .where("la <> lb")
            .groupBy(F.greatest("la", "lb").alias("root"))
            .agg(F.min(F.least("la", "lb")).alias("below"))
        )
        hooks = stored(hooks, f"{name}-hooks")
        if hooks.isEmpty():
            return labels.withColumnRenamed("label", "component")
        # Follow hooks to their ends: each step halves what is left of a chain.
        while True:
            nexts = hooks.select(F.col("root").alias("below"), F.col("below").alias("lower"))
            followed = hooks.join(nexts, "below", "left").select(
                "root", F.coalesce("lower", "below").alias("below"), F.col("lower").isNotNull().alias("moved")
            )
            followed = stored(followed, f"{name}-hooks")
            hooks = followed.drop("moved")
            if followed.where("moved").isEmpty():
                break
        labels = stored(
            labels.join(hooks.withColumnRenamed("root", "label"), "label", "left").select(
                "node", F.coalesce("below", "label").alias("label")
            ),
            f"{name}-labels",
        )
