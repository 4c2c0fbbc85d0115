"""Best-fit packing of documents into bins of fixed size, under conflict constraints.

A bin never holds two pieces of one source or of one cluster of duplicates, unless one of
the caller's choice says so. Rows are dealt out evenly over tasks, whatever their keys; each
task packs its rows into bins of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import quoted

CAPACITY = 8192
ROWS_PER_TASK = 10_000

# Pieces, and code points of their text, that are given out at once.
PAGE_ROWS = 4096
PAGE_CHARS = 1 << 20

ALL = -1  # a bitmap with every bit set: no bin at all


class Bins:
    """Open bins in the order of what they have left.

    A tree over the residuals 0..capacity holds in each node the bits that all bins below it
    share, sources and clusters alike. The search for the tightest compatible bin goes to the
    successor of the piece's length and on to the next larger residuals, and passes over any
    part of the tree in which every bin conflicts.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.shared = [ALL] * (2 * self.leaves)
        self.at: list[dict[int, int] | None] = [None] * (capacity + 1)
        self.n_bins = 0

    def _refresh(self, residual: int) -> None:
        held, bits = self.at[residual], ALL
        if held:
            for mask in held.values():
                bits &= mask
        node, shared = self.leaves + residual, self.shared
        shared[node] = bits
        node >>= 1
        while node:
            bits = shared[2 * node] & shared[2 * node + 1]
            if bits == shared[node]:
                break
            shared[node] = bits
            node >>= 1

    def _successor(self, low: int, bits: int) -> tuple[int, int] | None:
        """(residual, bin) of the smallest residual >= ``low`` with a bin free of ``bits``."""
        shared, leaves = self.shared, self.leaves
        todo, node = [], leaves + low
        # The nodes that cover low..: the leaf, then each right neighbour on the way up.
        todo.append(node)
        while node > 1:
            if not node & 1:
                todo.append(node + 1)
            node >>= 1
        for top in todo:
            stack = [top]
            while stack:
                node = stack.pop()
                if shared[node] < 0 or shared[node] & bits:  # empty, or all of it conflicts
                    continue
                if node < leaves:
                    stack += (2 * node + 1, 2 * node)
                    continue
                residual = node - leaves
                for number, mask in self.at[residual].items():
                    if not mask & bits:
                        return residual, number
        return None

    def put(self, length: int, bits: int) -> int:
        """The bin that takes a piece: the tightest compatible one, of equally tight ones that
        which has had that residual for longest, or a new one."""
        found = self._successor(length, bits)
        if found:
            residual, number = found
            mask = self.at[residual].pop(number) | bits
            self._refresh(residual)
        else:
            residual, number, mask = self.capacity, self.n_bins, bits
            self.n_bins += 1
        left = residual - length
        if left:
            if self.at[left] is None:
                self.at[left] = {}
            self.at[left][number] = mask
            self._refresh(left)
        return number


def pack_rows(
    lengths: list[int], sources: list, clusters: list, capacity: int
) -> tuple[list[int], list[int], int]:
    """For each row the bin of its last piece, the first bin of its full pieces, and the
    number of bins. Longest first, ties in the order of the rows; -1 for no piece."""
    bins = Bins(capacity)
    bits: dict = {}
    seen: dict = {}
    for key in [("s", s) for s in sources if s is not None] + [("c", c) for c in clusters if c is not None]:
        seen[key] = seen.get(key, 0) + 1
    # Only what occurs twice can conflict, and only that needs a bit.
    for key, times in seen.items():
        if times > 1:
            bits[key] = 1 << len(bits)
    last = [-1] * len(lengths)
    for row in sorted(range(len(lengths)), key=lambda r: -(lengths[r] % capacity)):
        size = lengths[row] % capacity
        if size:
            mask = bits.get(("s", sources[row]), 0) | bits.get(("c", clusters[row]), 0)
            last[row] = bins.put(size, mask)
    total, full = bins.n_bins, [-1] * len(lengths)
    for row, length in enumerate(lengths):
        if length >= capacity:
            full[row] = total
            total += length // capacity
    return last, full, total


def pack_task(
    batches: Iterator[pa.RecordBatch], names: list[str], capacity: int
) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's rows, with their text if ``names`` has it. The texts stay in the
    batches that they came in, and what is given out at once is bounded by rows and text."""
    with_text = "piece_text" in names
    held_batches = [batch for batch in batches if batch.num_rows]
    if not held_batches:
        return
    table = pa.Table.from_batches(held_batches)
    texts = table.column("text") if with_text else None
    table = table.drop_columns(["text"]) if with_text else table
    # The task's number sets its bins apart from those of other tasks.
    first_bin = table.column("task")[0].as_py() << 33
    places = pa.compute.sort_indices(
        table, [("length", "descending")] + [(name, "ascending") for name in ("doc_id", "cluster", "source")]
    )
    table, places = table.take(places), places.to_pylist()
    ids = table.column("doc_id").to_pylist()
    lengths = table.column("length").to_pylist()
    last, full, _ = pack_rows(
        lengths, table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity
    )
    used: dict[int, int] = {}
    out: list[list] = [[] for _ in names]

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(values, type=pa.string() if name == "piece_text" else pa.int64())
                for name, values in zip(names, out, strict=True)
            ],
            names=names,
        )
        for values in out:
            values.clear()
        return batch

    # In the order of packing, so that offsets follow it.
    size_out = 0
    for row in sorted(range(len(ids)), key=lambda r: -(lengths[r] % capacity)):
        length, whole = lengths[row], texts[places[row]].as_py() if texts is not None else None
        pieces = [(k, k * capacity, capacity, full[row] + k) for k in range(length // capacity)]
        if length % capacity or not length:
            k = length // capacity
            pieces.append((k, k * capacity, length - k * capacity, last[row]))
        for k, start, size, number in pieces:
            offset = used.get(number, 0)
            used[number] = offset + size
            values = [
                first_bin + number if number >= 0 else None,
                offset if number >= 0 else None,
                ids[row],
                k,
                start,
                size,
            ]
            if with_text:
                values.append(whole[start : start + size])
            for held, value in zip(out, values, strict=True):
                held.append(value)
            size_out += size
            if len(out[0]) >= PAGE_ROWS or (with_text and size_out >= PAGE_CHARS):
                yield flush()
                size_out = 0
    if out[0]:
        yield flush()


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text: str = "text",
    source: str | None = "source",
    cluster: str | None = None,
    clusters: DataFrame | None = None,
    with_text: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per piece: ``bin_id``, ``bin_offset``, ``doc_id``, ``piece``, ``piece_start``,
    ``piece_length`` and, if wanted, ``piece_text``. Lengths are code points.

    A text longer than ``capacity`` is cut into full pieces, which fill a bin each, and a
    rest. Rests are packed best-fit, longest first, into bins of their task. ``source`` and
    ``cluster`` (a column naming a group of duplicates; none: texts that are equal) are the
    constraints; a null one constrains nothing. ``clusters``, as ``minhash.labelled`` gives them,
    take the place of the column: near copies are then one cluster. A null or empty text is one piece of length
    0 without a bin. Rows need not differ, and each row is packed. ``bin_id`` is unique over
    all tasks; ``bin_offset`` is where the piece begins in its bin, in the order of packing.

    Rows are dealt round-robin to as many tasks as there are ``rows_per_task`` rows, so no
    key can fill a task. Dealing sorts the rows first, so that a task that is run again sees
    the same ones.
    """
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(quoted(id_col)).cast("bigint").alias("doc_id"),
        F.length(body).cast("bigint").alias("length"),
        (F.col(quoted(source)).cast("string") if source else F.lit(None).cast("string")).alias("source"),
        (F.col(quoted(cluster)).cast("string") if cluster else F.when(F.length(body) > 0, F.md5(body))).alias(
            "cluster"
        ),
        *([body.alias("text")] if with_text else []),
        *([F.xxhash64(F.col(quoted(text)).cast("string")).alias("text_key")] if clusters is not None else []),
    )
    if clusters is not None:
        known = clusters.select("doc_id", "text_key", F.col("component_id").cast("string").alias("cluster"))
        rows = rows.drop("cluster").join(known, ["doc_id", "text_key"], "left").drop("text_key")
    n_tasks = max(1, -(-docs.count() // rows_per_task))
    schema = T.StructType(
        [
            T.StructField("bin_id", T.LongType()),
            T.StructField("bin_offset", T.LongType()),
            T.StructField("doc_id", T.LongType()),
            T.StructField("piece", T.LongType()),
            T.StructField("piece_start", T.LongType()),
            T.StructField("piece_length", T.LongType()),
        ]
        + ([T.StructField("piece_text", T.StringType())] if with_text else [])
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack_task(batches, names, capacity)

    dealt = rows.repartition(n_tasks).withColumn("task", F.spark_partition_id().cast("bigint"))
    return dealt.mapInArrow(run, schema)
