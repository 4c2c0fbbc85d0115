"""Digests of what the operators put out, for checks against other implementations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .chat import read_back, unescape


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    state: list | None = None

    def close() -> None:
        if state is not None:
            key, n, turns, chars, loss, length = state
            done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), length))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        made = pa.RecordBatch.from_arrays(
            [pa.array(values, type=kind) for values, kind in zip(columns, kinds, strict=True)], names=names
        )
        done.clear()
        return made

    for batch in batches:
        columns = [
            batch.column(name).to_pylist()
            for name in ("conv_id", "output", "span_start", "text_start", "text_end", "loss")
        ]
        for key, output, start, text_start, text_end, loss in zip(*columns, strict=True):
            if state is None or state[0] != key:
                close()
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_back(output):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            if loss:
                learned = unescape(output[text_start - start : text_end - start])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(output)
        if done:
            yield flush()
    close()
    if done:
        yield flush()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back, in the order they come in, to one row per conversation."""
    return formatted.mapInArrow(
        _conversations,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint",
    )
