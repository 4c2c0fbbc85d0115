"""Run a function over the whole texts of a table, Arrow batch by Arrow batch.

Spark partitions the rows and ships them; what runs here is one small function per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T

ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


# Bytes of text that a function gets at once, the last one aside.
SLICE_BYTES = 4 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def filtered(docs: DataFrame, text: str, judge: Callable[[DataFrame, str, list[str]], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``judge`` leaves, with the columns of ``docs``.

    ``judge`` gets the rows under column names that clash with nothing, the name of the text
    and the names to keep.
    """
    names = docs.columns
    plain = [f"_column{place}" for place in range(len(names))]
    kept = judge(docs.toDF(*plain), plain[names.index(text)], plain)
    return kept.select(*plain).toDF(*names)


def text_slices(batch: pa.RecordBatch, text_at: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of whole rows, a new one after each ``most`` bytes of text. The number
    of rows in an Arrow batch is fixed, their bytes are not; what is made of them in Python
    takes several times as many."""
    lengths = pa.compute.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
    full = np.cumsum(lengths, dtype=np.int64) // (SLICE_BYTES if most is None else most)
    edges = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(edges, edges[1:], strict=False):
        yield batch.slice(start, stop - start)


def map_texts(
    df: DataFrame,
    text: str,
    fields: Sequence[tuple[str, str]],
    compute: Callable[[list[bytes]], Sequence],
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep`` columns of each row, and what ``compute`` makes of the texts.

    ``compute`` gets the UTF-8 bytes of some texts (a null text is empty), those of about
    ``SLICE_BYTES`` at most, and returns one sequence per field. A field replaces a kept column of the same name. A text that is
    kept travels once.
    """
    new = {name.lower() for name, _ in fields}
    kept = [name for name in keep if name.lower() not in new]
    once = text in kept and isinstance(df.schema[text].dataType, T.StringType)
    narrow = df.select(
        *[F.col(quoted(name)) for name in kept],
        *([] if once else [F.col(quoted(text)).cast("string").alias("\x00text")]),
    )
    schema = T.StructType(
        [narrow.schema[i] for i in range(len(kept))]
        + [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in fields]
    )
    names = [*kept, *[name for name, _ in fields]]
    kinds = [ARROW[kind] for _, kind in fields]
    width = len(kept)
    text_at = kept.index(text) if once else width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, text_at)):
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            made = compute([b"" if value is None else value for value in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(width)]
                + [
                    values if isinstance(values, pa.Array) else pa.array(values, type=kind)
                    for values, kind in zip(made, kinds, strict=True)
                ],
                names=names,
            )

    return narrow.mapInArrow(run, schema)


def runs_by_key(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """One table per run of rows with equal integer ``keys``; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        columns = [batch.column(name).to_numpy() for name in keys]
        change = np.zeros(n, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for start, stop in zip(edges, edges[1:], strict=False):
            key = tuple(column[start] for column in columns)
            if key != current and held:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def part_pairs(parts: str, key: str) -> Column:
    """For a row of a group that is split into ``parts``: the pairs of parts (``one`` <=
    ``two``) in which its own ``part``, by a hash of ``key``, meets each part of the group."""
    part = F.pmod(F.xxhash64(key), F.col(parts))
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1),
        lambda other: F.struct(
            F.least(part, other).alias("one"), F.greatest(part, other).alias("two"), part.alias("part")
        ),
    )
