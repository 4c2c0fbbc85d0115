"""Packing of token streams into training windows, in order, by dynamic programming.

The documents of a partition are one stream of ids. A window is a run of it, at most
``capacity`` ids long; where windows end is chosen so that padding and penalties for cut
documents are smallest together. Each partition is a stream of its own, read batch by batch.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import quoted

CAPACITY = 4096
END_ID = 2
# What a window's end costs, in ids of padding.
WINDOW_PENALTY = 1
SENTENCE_PENALTY = 32
INNER_PENALTY = 256
# Where no sentence ends for a whole window, it may be cut at so many places.
INNER_CUTS = 16

_WORDS_HELD = 500_000
_IDS_HELD = 8_000_000
# What may follow the sign that ends a sentence.
_CLOSERS = "\"')]}»”’"
# Texts that the tokenizer's normalizer only lower-cases and rids of white space. Their parts are
# those of its pattern; signs keep a space that follows, and a line end is a part without ids.
_PLAIN = re.compile(r"[\x00-\x7f\u00c0-\u00ff]*")
_LETTERS = r"a-z\u00df-\u00f6\u00f8-\u00ff"
_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9\x20\x09-\x0d{_LETTERS}]+\x20?|\n")
# It shows bytes as printable characters, the others shifted up in the order of their values.
_HIDDEN = [*range(33), *range(127, 161), 173]
_SHOWN = {byte: 256 + n for n, byte in enumerate(_HIDDEN)}
# Neither is a word of a UTF-8 text.
_LINE_END, _TEXT_END = b"\xff", b"\xfe"


class WordIds(dict):
    """Numbers the parts of texts, and keeps the ids of each.

    The tokenizer drops white space and nothing reaches across it, so the ids of a text are
    those of its words at ASCII white space, one after the other: keys of bytes. Plain texts
    are cut further, into parts that the model is given as they are: keys of str.
    """

    def __init__(self, tokenizer, end_id: int):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.end_id = end_id
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new: list[bytes | str] = []
        self.flat = np.array([self.end_id], dtype=np.uint32)
        self.starts = np.array([0, 0, 1], dtype=np.int64)
        self.closes = np.array([True, True])
        self[_LINE_END], self[_TEXT_END] = 0, 1

    def __missing__(self, key: bytes | str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number

    def _ids_of_part(self, part: str) -> list[int]:
        if part == "\n":
            return []
        if part[-1] == " ":
            part = part[:-1]
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(_SHOWN)
        return [token.id for token in self.model.tokenize(part)]

    def _learn(self) -> None:
        if not self.new:
            return
        words = [key.decode() for key in self.new if isinstance(key, bytes)]
        of_words = iter(self.tokenizer.encode_batch_fast(words, add_special_tokens=False))
        made, closes = [], []
        for key in self.new:
            if isinstance(key, bytes):
                made.append(next(of_words).ids)
                closes.append(key.decode().rstrip(_CLOSERS).endswith((".", "!", "?")))
            else:
                made.append(self._ids_of_part(key))
                closes.append(key == "\n" or key[-1] == " " and not {".", "!", "?"}.isdisjoint(key))
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        new = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=int(sizes.sum()))
        self.flat = np.concatenate([self.flat, new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.closes = np.concatenate([self.closes, np.array(closes)])
        self.new = []

    def stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the texts, each followed by the end id; where each text ends; and where
        sentences or lines end, texts included."""
        if len(self) > _WORDS_HELD or len(self.flat) > _IDS_HELD:
            self._empty()
        numbers: list[np.ndarray] = []
        for data in texts:
            text = data.decode()
            if _PLAIN.fullmatch(text):
                parts = _PART.findall(text.lower())
            else:
                parts = data.replace(b"\n", b" \xff ").split()
            parts.append(_TEXT_END)
            numbers.append(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)))
        # Nothing here is part of a circle, and there is much to go through in search of them.
        gc.disable()
        try:
            self._learn()
        finally:
            gc.enable()
        word = np.concatenate([np.empty(0, dtype=np.int64), *numbers])
        first, size = self.starts[word], self.starts[word + 1] - self.starts[word]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        closed = np.unique(ends[self.closes[word]])
        return ids, ends[word == 1], closed[closed > 0]


class Windows:
    """The cheapest row of windows over a stream that grows.

    ``cost[j]`` is that of the best row of windows that ends at candidate ``j``. Padding to
    the capacity falls evenly with a window's length, so that the best start is the smallest
    cost plus position among those in reach, kept in a queue of rising values; windows whose
    length is a power of two have no padding and are looked at one by one. What all open ends
    agree on is given out and forgotten.
    """

    def __init__(self, capacity: int, window_penalty: int = WINDOW_PENALTY):
        self.capacity = capacity
        self.window_penalty = window_penalty
        self.at, self.cost, self.before = [0], [0], [-1]
        self.queue: deque[int] = deque([0])

    def extend(self, places: np.ndarray, penalties: np.ndarray) -> None:
        """Add candidates, in rising order, at most ``capacity`` apart."""
        old = len(self.at)
        every = np.concatenate([np.array(self.at, dtype=np.int64), places])
        ends, starts = [], []
        for power in range(self.capacity.bit_length()):
            if 1 << power < self.capacity:
                wanted = places - (1 << power)
                found = np.searchsorted(every, wanted)
                hit = every[found] == wanted
                ends.append(np.flatnonzero(hit))
                starts.append(found[hit])
        end, start = np.concatenate([np.empty(0, np.int64), *ends]), np.concatenate([np.empty(0, np.int64), *starts])
        order = np.argsort(end, kind="stable")
        exact, edges = start[order].tolist(), np.searchsorted(end[order], np.arange(len(places) + 1)).tolist()
        at, cost, before, queue, capacity = self.at, self.cost, self.before, self.queue, self.capacity
        for n, (place, penalty) in enumerate(zip(places.tolist(), penalties.tolist(), strict=True)):
            while at[queue[0]] < place - capacity:
                queue.popleft()
            via = queue[0]
            least = cost[via] + at[via] + capacity - place
            for other in exact[edges[n] : edges[n + 1]]:
                if cost[other] < least:
                    least, via = cost[other], other
            least += penalty + self.window_penalty
            while queue and cost[queue[-1]] + at[queue[-1]] > least + place:
                queue.pop()
            queue.append(old + n)
            at.append(place)
            cost.append(least)
            before.append(via)

    def settled(self, last: bool = False) -> list[int]:
        """The cuts that no longer depend on what comes, from the last given one on; with
        ``last`` all of them, the end included."""
        at, before = self.at, self.before
        top = len(at) - 1
        if not last:
            # Candidates in reach of the next one; their ways back soon meet.
            live = {n for n in range(top, -1, -1) if at[n] >= at[top] - self.capacity}
            while len(live) > 1:
                n = max(live)
                live.remove(n)
                live.add(before[n] if n else 0)
            top = live.pop()
        cuts, n = [], top
        while n > 0:
            cuts.append(at[n])
            n = before[n]
        cuts.append(at[0])
        if top:
            kept = self.cost[top]
            self.at = at[top:]
            self.cost = [value - kept for value in self.cost[top:]]
            self.before = [-1] + [max(n - top, 0) for n in before[top + 1 :]]
            self.queue = deque(n - top for n in self.queue if n >= top)
        return cuts[::-1]


def with_inner_cuts(
    texts: np.ndarray, sentences: np.ndarray, start: int, capacity: int, sentence: int, inner: int
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates from ``start`` on and their penalties: none where a text ends."""
    before = np.concatenate([[start], sentences[:-1]])
    wide = sentences - before > capacity
    step = max(1, capacity // INNER_CUTS)
    more = [np.arange(a + step, b, step) for a, b in zip(before[wide].tolist(), sentences[wide].tolist(), strict=True)]
    added = np.concatenate([np.empty(0, dtype=np.int64), *more])
    places = np.concatenate([sentences, added])
    penalties = np.concatenate(
        [np.where(np.isin(sentences, texts, assume_unique=True), 0, sentence), np.full(len(added), inner)]
    )
    order = np.argsort(places, kind="stable")
    return places[order], penalties[order]


def pack_windows(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    sentence_penalty: int = SENTENCE_PENALTY,
    inner_penalty: int = INNER_PENALTY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a window: ``doc_id``, ``start`` (its first id in the
    document), ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit
    integers), ``doc_tokens``, ``sequence_id``, ``offset`` (in the window), and with
    ``with_ids`` the ``ids``.

    A text's ids are those of the tokenizer file ``path``, which drops white space, followed
    by ``end_id``; the names of special tokens in a text are ordinary text. Documents stay in
    the order of their partition, and so do the pieces: a document that does not end in a
    window goes on at the start of the next one. Windows are padded to ``capacity``, except
    those whose length is a power of two. Their ends minimise, over all rows of windows of the
    partition, padding plus penalties: none at the end of a document, ``sentence_penalty`` at
    that of a sentence or line in it, ``inner_penalty`` elsewhere, which is only tried where
    no sentence ends for a whole window; of equal ones, that with fewer windows is taken.

    A null or empty text is its end id alone. Rows without a doc_id, repeated rows and rows
    that share a doc_id are documents like any others. An empty table has no pieces. Other
    columns are ignored. A partition that is run again gives the same pieces, as long as its
    rows come in the same order, as those of files do.
    """
    with open(path, encoding="utf-8") as file:
        # A vocabulary is of fixed size.
        tables = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(
        F.col(quoted(id_col)).cast("bigint").alias("doc_id"),
        F.encode(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), "UTF-8").alias("text"),
        F.spark_partition_id().cast("bigint").alias("task"),
    )
    fields = [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    fields += [("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    fields += [("ids", "array<bigint>")] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tables.value, end_id)
        windows = Windows(capacity)
        # What no window has yet: ids from ``base`` on, and documents by their starts.
        base, n_windows, task = 0, 0, 0
        ids = np.empty(0, dtype=np.uint32)
        starts, sizes, names = (np.empty(0, dtype=np.int64) for _ in range(3))
        known = np.empty(0, dtype=bool)

        def given(cuts: list[int]) -> pa.RecordBatch:
            cut = np.array(cuts, dtype=np.int64)
            inside = starts[(starts > cut[0]) & (starts < cut[-1])]
            edges = np.union1d(cut, inside)
            begin, length = edges[:-1], np.diff(edges)
            doc = np.searchsorted(starts, begin, side="right") - 1
            window = np.searchsorted(cut, begin, side="right") - 1
            raw = memoryview(ids.astype("<u4").tobytes())
            spans = [((a - base) * 4, (a - base + n) * 4) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [
                pa.array(names[doc], type=pa.int64(), mask=~known[doc]),
                begin - starts[doc],
                length,
                np.array([zlib.crc32(raw[a:b]) for a, b in spans], dtype=np.int64),
                sizes[doc],
                (task << 33) + n_windows + window,
                begin - cut[window],
            ]
            if with_ids:
                within = ids[cut[0] - base : cut[-1] - base].astype(np.int64)
                columns.append(pa.ListArray.from_arrays((edges - cut[0]).astype(np.int32), within))
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[name for name, _ in fields]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(2)[0].as_py()
            made, texts, sentences = words.stream(batch.column(1).to_pylist())
            end = base + len(ids)
            places, penalties = with_inner_cuts(
                texts + end, sentences + end, end, capacity, sentence_penalty, inner_penalty
            )
            begins = np.concatenate([[0], texts[:-1]])
            ids = np.concatenate([ids, made])
            starts, sizes = np.concatenate([starts, begins + end]), np.concatenate([sizes, texts - begins])
            names = np.concatenate([names, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)])
            known = np.concatenate([known, batch.column(0).is_valid().to_numpy(zero_copy_only=False)])
            windows.extend(places, penalties)
            cuts = windows.settled()
            if len(cuts) > 1:
                yield given(cuts)
                n_windows += len(cuts) - 1
                ids, base = ids[cuts[-1] - base :], cuts[-1]
                keep = max(0, int(np.searchsorted(starts, base, side="right")) - 1)
                starts, sizes, names, known = starts[keep:], sizes[keep:], names[keep:], known[keep:]
        cuts = windows.settled(last=True)
        if len(cuts) > 1:
            yield given(cuts)

    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in fields))


def _word_ids(vocabulary: str, end_id: int) -> WordIds:
    # Spark has a process per core already.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return WordIds(tokenizer, end_id)
