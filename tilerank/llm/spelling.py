"""Spelling variants: words one change apart, found with a bidirectional FM-index.

A change leaves one half of a word as it is. Words are dealt by their halves to tasks, which
index the words they get, block by block. A search matches one half exactly and then goes on
across the other, in the other direction, with one error. What it holds on the way are ranges
of ranks among the sorted suffixes of the block's words, written one after the other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.workspace import stored
from .arrow import quoted

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
CHANGED_ONE_IN = 199
BLOCK_CHARS = 1 << 16
PART_WORDS = 4096

_CHUNK = 4096
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_END, _DELIMITER, _FIRST = 0, 1, 2


def count_words(docs: DataFrame, id_col: str, text: str, least_length: int) -> DataFrame:
    """``word`` and ``n`` of all words of ``least_length``, changed runs included."""
    rows = docs.select(
        F.encode(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")), "UTF-8").alias("key"),
        F.encode(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), "UTF-8").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of_key = zlib.crc32(key + b":")
                found = Counter(_RUN.findall(data.translate(_LOWER).decode()))
                for word, n in found.items():
                    code = zlib.crc32(word.encode(), of_key)
                    if not code % CHANGED_ONE_IN:
                        at = code % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        counts[word] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())],
                names=["word", "c"],
            )

    return rows.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("n"))


def _sorted_suffixes(codes: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by sorting on doubled lengths; the last code is the
    least and occurs once."""
    rank = codes.astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(len(codes), dtype=np.int64)
        ahead[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        change = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(len(codes), dtype=np.int64)
        rank[order] = change
        if change[-1] == len(codes) - 1 or width >= len(codes):
            return order
        width *= 2


class _Ranks:
    """One direction of the index: for each rank how many smaller symbols come before the
    suffixes of lower rank."""

    def __init__(self, codes: np.ndarray, n_symbols: int):
        self.order = _sorted_suffixes(codes)
        ahead = codes[self.order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n_symbols))])
        # less[i, c]: symbols below c ahead of the first i suffixes.
        self.less = np.zeros((len(codes) + 1, n_symbols + 1), dtype=np.int32)
        for symbol in range(n_symbols):
            np.cumsum(ahead == symbol, out=self.less[1:, symbol + 1])
        np.cumsum(self.less, axis=1, out=self.less)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray):
        """The ranges with a symbol ahead, and by how much the other direction's move."""
        at_low, at_high = self.less[low, symbol], self.less[high, symbol]
        first = self.starts[symbol]
        return (
            first + self.less[low, symbol + 1] - at_low,
            first + self.less[high, symbol + 1] - at_high,
            at_high - at_low,
        )

    def branches(self, low: np.ndarray, high: np.ndarray):
        """All (row, symbol) by which the ranges can be extended to letters."""
        inside = np.diff(self.less[high] - self.less[low], axis=1)
        row, letter = np.nonzero(inside[:, _FIRST:])
        return row, letter + _FIRST


class Index:
    """A bidirectional FM-index of distinct words, a delimiter before and after each."""

    def __init__(self, words: list[str], letters: str):
        joined = "\x01" + "\x01".join(words) + "\x01"
        self.symbols = np.unique(self._points(joined + letters))
        codes = self.codes(joined)
        n_symbols = len(self.symbols) + _DELIMITER
        self.backward = _Ranks(np.append(codes, _END), n_symbols)
        self.forward = _Ranks(np.append(codes[::-1], _END), n_symbols)
        self.length = len(codes)
        self.begins = np.flatnonzero(codes == _DELIMITER)[:-1]

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text of known letters; U+0001, which no word has, delimits."""
        return np.searchsorted(self.symbols, self._points(text)).astype(np.int64) + _DELIMITER

    def near(self, words: list[str], shorter: np.ndarray, from_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) where the word is one change from the query, the shorter of the two
        has the given length, and they share that one's left (or else right) half.

        A search for a common left half adds its symbols from right to left and the delimiter;
        both directions' ranges are kept in step, so that it can turn and go on to the right.
        """
        # The mirror image of a word and of the index is searched in the same way.
        match, cross = (self.backward, self.forward) if from_left else (self.forward, self.backward)
        text = [self.codes(word if from_left else word[::-1]) for word in words]
        sizes = np.array([len(t) for t in text])
        flat = np.concatenate([np.append(t, _DELIMITER) for t in text])
        base = np.cumsum(sizes + 1) - sizes - 1
        half = shorter // 2 if from_left else shorter - shorter // 2
        n = len(words)
        low, other = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        high = np.full(n, self.length + 1, dtype=np.int64)
        for step in range(int(half.max()) + 1):
            rows = np.flatnonzero(half >= step)
            # The half's symbols from its last to its first, then the delimiter.
            at = base[rows] + half[rows] - 1 - step
            symbol = np.where(half[rows] > step, flat[np.maximum(at, 0)], _DELIMITER)
            low[rows], high[rows], moved = match.extend(low[rows], high[rows], symbol)
            other[rows] += moved
        low, high = other, other + high - low

        longer = sizes > shorter  # the query is the longer one: one of its letters goes
        query, place, spent = np.arange(n), half.copy(), np.zeros(n, dtype=bool)
        found_query, found_rank = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(query):
            symbol = flat[base[query] + place]
            inside = place < sizes[query]
            lows, highs, _ = cross.extend(low, high, symbol)
            alive = lows < highs
            ended = alive & ~inside & spent
            found_query.append(query[ended])
            found_rank.append(lows[ended])
            go = alive & inside
            parts = [(query[go], place[go] + 1, spent[go], lows[go], highs[go])]
            skip = ~spent & longer[query] & inside
            parts.append((query[skip], place[skip] + 1, ~spent[skip], low[skip], high[skip]))
            free = np.flatnonzero(~spent & ~longer[query])
            if len(free):
                row, letter = cross.branches(low[free], high[free])
                row = free[row]
                lows, highs, _ = cross.extend(low[row], high[row], letter)
                done = np.ones(len(row), dtype=bool)
                parts.append((query[row], place[row], done, lows, highs))
                change = inside[row] & (letter != symbol[row])
                parts.append((query[row][change], place[row][change] + 1, done[change], lows[change], highs[change]))
            query, place, spent, low, high = (np.concatenate(column) for column in zip(*parts, strict=True))
        rank = np.concatenate(found_rank)
        # With both delimiters matched, a range is one word; its suffix starts at its outer end.
        start = cross.order[rank]
        begin = self.length - 1 - start if from_left else start
        edges = self.begins if not from_left else np.append(self.begins[1:], self.length - 1)
        word = np.searchsorted(edges, begin)
        pairs = np.unique(np.stack([np.concatenate(found_query), word]), axis=1)
        return pairs[0], pairs[1]


def _answers(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The near words of a block's rows (word, n, shorter, left, indexed, asked)."""
    counts = {word: n for word, n, _, _, indexed, _ in rows if indexed}
    if not counts or len({word for word, *_ in rows}) < 2:
        return
    words = list(counts)
    index = Index(words, "".join({letter for word, *_ in rows for letter in word}))
    for side in (True, False):
        asked = [(word, shorter) for word, _, shorter, left, _, asks in rows if asks and left == side]
        for at in range(0, len(asked), _CHUNK):
            some = asked[at : at + _CHUNK]
            query, found = index.near([word for word, _ in some], np.array([m for _, m in some]), side)
            if len(query):
                near = [words[k] for k in found.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([some[k][0] for k in query.tolist()], type=pa.string()),
                        pa.array(near, type=pa.string()),
                        pa.array([counts[word] for word in near], type=pa.int64()),
                    ],
                    names=["word", "near", "near_n"],
                )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, part and slice; whole ones are put together to blocks."""
    block: list[tuple] = []
    group: list[tuple] = []
    key, chars, more = None, 0, 0
    for batch in batches:
        names = ("bucket", "part", "slice", "word", "n", "shorter", "left", "indexed", "asked")
        columns = [batch.column(name).to_pylist() for name in names]
        for bucket, part, piece, *row in zip(*columns, strict=True):
            if (bucket, part, piece) != key:
                # A group of one row has nothing to find.
                if len(group) > 1:
                    if chars + more > BLOCK_CHARS:
                        yield from _answers(block)
                        block, chars = [], 0
                    block += group
                    chars += more
                group, key, more = [], (bucket, part, piece), 0
            group.append(tuple(row))
            more += len(row[0]) + 1
    if len(group) > 1:
        block += group
    yield from _answers(block)


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, part_words: int = PART_WORDS) -> DataFrame:
    """``word``, ``near`` and ``near_n``, each way, for words (``word``, ``n``, distinct) that
    differ by one inserted, deleted or replaced code point.

    A word goes to four groups: by the left and right halves of its length, and of a length
    less by one, so that two near words share a group of the shorter one's length. Groups above
    ``part_words`` are split: each part indexes its own words, and is asked for all, slice by
    slice, so that no task holds more than a part and a slice of one group.
    """
    sides = words.withColumn("_length", F.length("word")).withColumn(
        "shorter", F.explode(F.array(F.col("_length"), F.col("_length") - 1))
    )
    half = F.floor(F.col("shorter") / 2).cast("int")
    grouped = (
        sides.where(F.col("shorter") >= least_length)
        .withColumn("left", F.explode(F.array(F.lit(True), F.lit(False))))
        .withColumn(
            "_half",
            F.when(F.col("left"), F.substring("word", F.lit(1), half)).otherwise(
                F.substring("word", F.col("_length") - (F.col("shorter") - half) + 1, F.col("_length"))
            ),
        )
        .select("word", "n", "shorter", "left", F.xxhash64("shorter", "left", "_half").alias("bucket"))
    )
    large = stored(
        grouped.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > part_words)
        .select("bucket", F.ceil(F.col("_rows") / part_words).cast("bigint").alias("_parts")),
        "large-groups",
    )
    own = F.pmod(F.xxhash64("word"), F.col("_parts"))

    def place(part, piece, indexed: bool, asked: bool):
        return F.struct(
            part.alias("part"), piece.alias("slice"), F.lit(indexed).alias("indexed"), F.lit(asked).alias("asked")
        )

    every = F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)
    split = F.concat(
        F.transform(every, lambda part: place(part, own, False, True)),
        F.transform(every, lambda piece: place(own, piece, True, False)),
    )
    none = F.lit(0).cast("bigint")
    placed = (
        grouped.join(large, "bucket", "left")
        .withColumn(
            "_at", F.explode(F.when(F.col("_parts").isNull(), F.array(place(none, none, True, True))).otherwise(split))
        )
        .select("bucket", "_at.part", "_at.slice", "word", "n", "shorter", "left", "_at.indexed", "_at.asked")
    )
    cell = ["bucket", "part", "slice"]
    found = (
        placed.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_search, "word string, near string, near_n bigint")
    )
    # A pair can meet by both halves, and by others of its block.
    return found.dropDuplicates(["word", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for words that have a form. Counts rise along forms, so there are
    no circles; each round doubles the steps."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nexts = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        followed = stored(
            roots.join(nexts, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "roots",
        )
        roots = followed.drop("_moved")
        if followed.where("_moved").isEmpty():
            return roots


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` for each word.

    Runs ``[A-Za-z\u00C0-\u00FF]+`` of the texts are lower-cased (A-Z only). Where 199 divides
    the crc32 h of ``<id>:<run>``, the run loses its code point h % length. Words are the
    results of at least ``least_length`` (4 or more) code points that occur ``least_count``
    times. Two are near if they differ by one inserted, deleted or replaced code point. The
    form of a word is its near word of largest ``n``, of equal ones the first in code-point
    order, if that occurs at least ``ratio`` times as often; ``root`` follows forms to the last.

    A null text has no runs; a null id counts as an empty one. Repeated rows count as often as
    they come. An empty table has no words. Other columns of ``docs`` are ignored.
    """
    counts = count_words(docs, id_col, text, least_length)
    words = stored(counts.where(F.col("n") >= least_count), "words")
    best = (
        near_words(words, least_length, part_words)
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("_minus"), F.col("near").alias("form"))).alias("_best"),
        )
        .select("word", "n_near", F.col("_best.form").alias("_form"), (-F.col("_best._minus")).alias("_form_n"))
    )
    fits = F.col("_form_n") >= ratio * F.col("n")
    judged = stored(
        words.join(best, "word", "left").select(
            "word",
            F.when(fits, F.col("_form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(fits, F.col("_form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
