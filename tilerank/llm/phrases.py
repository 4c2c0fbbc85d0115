"""Phrases that stick together, per language: which runs of words occur often is mined after
Toivonen, and each is rated by the weakest place at which it could be cut.

A sample proposes the frequent phrases. A pass over everything counts exactly what was
proposed and its negative border: the phrases that were not proposed although all of their
parts were. Where one of the border is frequent after all, what lies above it has not been
counted, and a further pass counts that, until the border holds no frequent phrase. Passes
count 62-bit hashes, as nearly all of the border is rare; a last one counts, as they are
written, the phrases whose hashes are frequent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.workspace import stored
from .arrow import quoted
from .words import mix

LEAST = 30
LONGEST = 4
CONTAINED_PERCENT = 80
TOP = 2000
SAMPLE_PARTS = 8
FILTER_BITS = 1 << 26

_SLICE_WORDS = 1 << 19
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# A-Z lower-cased; what ends a piece becomes a byte that no UTF-8 text has.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\n\v\f\r", bytes(range(97, 123)) + _BREAK * 10
)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _in(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    mask = np.uint64(len(filter_words) * 64 - 1)
    found = np.ones(len(hashes), dtype=bool)
    for place in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        bits = filter_words[(place >> np.uint64(6)).astype(np.int64)]
        found &= (bits >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def _hashed(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes whose low two bits tell the number of words, less one."""
    return mix(hashes) & ~np.uint64(3) | np.uint64(size - 1)


class _Stream:
    """Words of one language as numbers, 0 being a break, and the hashes of words."""

    def __init__(self, lang: str, distinct: list[bytes], ids: list[int]):
        self.ids = np.array(ids, dtype=np.int64)
        self.distinct = distinct
        self.of_word = np.array([xxhash.xxh64_intdigest(word) for word in distinct], dtype=np.uint64)
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        self.of_one = _hashed(seed + self.of_word * _FACTOR, 1)

    def longer(self, at: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` at ``at``, from those that lack the last word."""
        return _hashed(hashes + self.of_word[self.ids[at + size - 1]] * _FACTOR, size)

    def border(self, new: np.ndarray, old: np.ndarray | None, longest: int, above: bool):
        """Hashes and counts of the phrases whose first and last words but one are in ``new``,
        and of all words; with ``old`` only of those that were not counted with that. With
        ``above``, what is counted now is taken as if it were in ``new``."""
        ids = self.ids
        if old is None:
            counts = np.bincount(ids, minlength=len(self.distinct))
            yield self.of_one[1:], counts[1:]
        is_word = np.arange(len(self.distinct)) > 0
        inside = (_in(new, self.of_one) & is_word)[ids]
        before = (_in(old, self.of_one) & is_word)[ids] if old is not None else np.zeros(len(ids), dtype=bool)
        hashes = self.of_one[ids]
        for size in range(2, longest + 1):
            n = max(len(ids) - size + 1, 0)
            at = np.flatnonzero(inside[:n] & inside[1 : n + 1])
            found = self.longer(at, hashes[at], size)
            done = before[at] & before[at + 1]
            fresh = found if old is None else found[~done]
            if len(fresh):
                yield np.unique(fresh, return_counts=True)
            in_new = _in(new, found) | ~done if above else _in(new, found)
            hashes, inside, had = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            hashes[at], inside[at] = found, in_new
            if old is not None:
                had[at] = done & _in(old, found)
            before = had

    def phrases(self, held: np.ndarray, longest: int):
        """Phrases of the filter, their length and counts."""
        ids, hashes = self.ids, self.of_one[self.ids]
        names = words = pa.array([b"", *self.distinct[1:]], type=pa.string())
        counts = np.bincount(ids, minlength=len(words))
        chosen = _in(held, self.of_one)
        chosen[0] = False
        yield names.filter(pa.array(chosen)), 1, counts[chosen]
        number = np.where(chosen[ids], ids, -1)
        for size in range(2, longest + 1):
            n = max(len(ids) - size + 1, 0)
            at = np.flatnonzero((number[:n] >= 0) & (number[1 : n + 1] >= 0))
            found = self.longer(at, hashes[at], size)
            near = _in(held, found)
            at, found = at[near], found[near]
            key = number[at] * len(words) + ids[at + size - 1]
            _, first, which, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            begin, last = number[at[first]], ids[at[first] + size - 1]
            names = pc.binary_join_element_wise(names.take(pa.array(begin)), words.take(pa.array(last)), " ")
            yield names, size, counts
            hashes, number = np.zeros(n, dtype=np.uint64), np.full(n, -1)
            hashes[at], number[at] = found, which


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[str, _Stream]]:
    by_lang: dict[str, list[int]] = {}
    for row, lang in enumerate(batch.column(0).to_pylist()):
        by_lang.setdefault(lang, []).append(row)
    for lang, rows in by_lang.items():
        numbers, ids = _Numbers({_BREAK: 0}), []
        for row in rows:
            data = batch.column(1)[row].as_py()
            ids += map(numbers.__getitem__, data.translate(_TABLE).replace(_BREAK, b" \xff ").split())
            ids.append(0)
            if len(ids) >= _SLICE_WORDS:
                yield lang, _Stream(lang, list(numbers), ids)
                numbers, ids = _Numbers({_BREAK: 0}), []
        if ids:
            yield lang, _Stream(lang, list(numbers), ids)


@contextmanager
def _shared(spark: SparkSession, *filters: np.ndarray | None):
    """The filters as tasks get them, until the job that needs them is done."""
    packed = [None if words is None else zlib.compress(words.tobytes(), 1) for words in filters]
    held = spark.sparkContext.broadcast(packed)
    try:
        yield held
    finally:
        held.destroy()


def _unpacked(held) -> list[np.ndarray | None]:
    return [None if raw is None else np.frombuffer(zlib.decompress(raw), dtype=np.uint64) for raw in held.value]


def count_border(texts: DataFrame, shared, longest: int, above: bool) -> DataFrame:
    """``hash`` and ``f`` of what the first of the ``shared`` filters lets count and the
    second, if any, did not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = _unpacked(shared)
        for batch in batches:
            for _, stream in _streams(batch):
                for hashes, counts in stream.border(new, old, longest, above):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "c"]
                    )

    # A phrase that fills many texts is added up in each task first.
    return texts.mapInArrow(run, "hash bigint, c bigint").groupBy("hash").agg(F.sum("c").alias("f"))


def count_phrases(texts: DataFrame, shared, longest: int) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``f`` of the phrases of a filter, and a row of 0
    words with the number of all words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (held,) = _unpacked(shared)
        for batch in batches:
            for lang, stream in _streams(batch):
                total = (pa.array([None], type=pa.string()), 0, np.array([np.count_nonzero(stream.ids)]))
                for phrases, size, counts in (total, *stream.phrases(held, longest)):
                    n = len(phrases)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang]).take(pa.array(np.zeros(n, dtype=np.int64))),
                            phrases,
                            pa.array(np.full(n, size, dtype=np.int32)),
                            pa.array(counts.astype(np.int64)),
                        ],
                        names=["lang", "phrase", "words", "c"],
                    )

    rows = texts.mapInArrow(run, "lang string, phrase string, words int, c bigint")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f"))


def _added(phrases: DataFrame, held: np.ndarray) -> np.ndarray | None:
    """``held`` and the bits of the phrases that are not in it; None if all are.

    What comes to the driver is at most the filter itself, whatever the number of phrases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known,) = _unpacked(shared)
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~_in(known, hashes.view(np.uint64))))

    mask = len(held) * 64 - 1
    place = F.explode(
        F.array(F.col("hash").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(mask)))
    )
    with _shared(phrases.sparkSession, held) as shared:
        bits = (
            phrases.select("hash")
            .mapInArrow(run, "hash bigint")
            .select(place.alias("place"))
            .groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits"))
            .toArrow()
        )
    if not bits.num_rows:
        return None
    filled = held.copy()
    filled[bits.column("word").to_numpy()] |= bits.column("bits").to_numpy().view(np.uint64)
    return filled


def propose(sample: DataFrame, least: int, longest: int, nothing: np.ndarray) -> np.ndarray:
    """The filter of all phrases up to ``longest`` words that occur ``least`` times, found
    length by length."""
    held, old = nothing, None
    for _ in range(longest):
        with _shared(sample.sparkSession, held, old) as shared:
            counts = stored(count_border(sample, shared, longest, False).where(F.col("f") >= least), "sampled")
        more = _added(counts, held)
        if more is None:
            break
        old, held = held, more
    return held


def frequent_phrases(texts: DataFrame, least: int, longest: int, proposed: np.ndarray) -> DataFrame:
    """All phrases of up to ``longest`` words that occur ``least`` times, with exact counts,
    and a row of 0 words with the number of all words of each language.

    The second pass counts all that lies above the border's failures at once: it takes what it
    counts as proposed. So its own border, phrases with a part that is rare, cannot fail.
    """
    spark = texts.sparkSession
    with _shared(spark, proposed, None) as shared:
        counted = count_border(texts, shared, longest, False)
        found = [stored(counted.where(F.col("f") >= least), "border")]
    shorter = F.col("hash").bitwiseAND(F.lit(3)) < longest - 1
    more = _added(found[0].where(shorter), proposed)
    if more is not None:
        with _shared(spark, more, proposed) as shared:
            counted = count_border(texts, shared, longest, True)
            found.append(stored(counted.where(F.col("f") >= least), "border"))
    every = reduce(DataFrame.unionByName, found)
    # Hashes that meet by chance only make a phrase counted in vain.
    held = _added(every, np.zeros_like(proposed))
    if held is None:
        held = np.zeros_like(proposed)
    with _shared(spark, held) as shared:
        counts = count_phrases(texts, shared, longest)
        return stored(counts.where((F.col("words") == 0) | (F.col("f") >= least)), "phrases")


def _rest(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = LEAST,
    top: int = TOP,
    contained_percent: int = CONTAINED_PERCENT,
    sample_parts: int = SAMPLE_PARTS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``,
    ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these into
    words ``[^\\x20\\x09]+``. Candidates are phrases of 2 to 4 words that occur ``a`` >=
    ``least`` times within pieces, overlaps included. Cut after its first k words, a candidate
    has parts that occur ``l`` and ``r`` times and the score floor(2000000 a / (l + r)); the
    lowest counts, of equal ones that with the smallest k. Candidates inside of a longer one
    that occurs ``contained_percent`` as often are dropped. They are ranked by score and ``a``,
    both descending, and phrase. ``n`` is the number of all words of the language.

    The sample is one of ``sample_parts`` parts of the texts by hash, mined with a lower bound.
    It only proposes: counts, and which phrases there are, come from all rows. What is
    proposed travels as a filter of ``filter_bits`` bits (a power of two), whatever its number;
    a wrong yes makes a phrase counted in vain, and there is no wrong no.

    A null ``lang`` is ``und``. Null and empty texts have no words. Repeated rows count as
    often as they come. A language without candidates, or an empty table, gives no rows.
    Other columns of ``docs`` are ignored.
    """
    texts = docs.select(
        F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"),
        F.encode(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), "UTF-8").alias("text"),
    )
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(sample_parts)) == 0)
    nothing = np.zeros(filter_bits // 64, dtype=np.uint64)
    lower = max(2, least // (2 * sample_parts))
    proposed = propose(sample, lower, LONGEST - 1, nothing)
    frequent = frequent_phrases(texts, least, LONGEST, proposed)

    totals = frequent.where("words = 0").select("lang", F.col("f").alias("n"))
    counts = frequent.where("words > 0").select("lang", "phrase", "words", "f")
    candidates = counts.where("words > 1").withColumnRenamed("f", "a")
    split = candidates.withColumn("_words", F.split("phrase", " "))
    part = counts.select("lang", F.col("phrase").alias("part"), "f")
    cuts = (
        split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .select(
            "lang",
            "phrase",
            "a",
            "k",
            _rest(F.col("_words"), 1, F.col("k")).alias("_left"),
            _rest(F.col("_words"), F.col("k") + 1, F.col("words") - F.col("k")).alias("_right"),
        )
        .join(part.select("lang", F.col("part").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
        .join(part.select("lang", F.col("part").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
        .withColumn("score", F.expr("(2000000BD * a) div (cast(l AS decimal(20, 0)) + r)"))
    )
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # All runs of two words or more inside of longer candidates.
    inner = (
        split.where("words > 2")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
        .groupBy("lang", _rest(F.col("_words"), F.col("start"), F.col("size")).alias("phrase"))
        .agg(F.max("a").alias("_longer"))
    )
    kept = (
        weakest.join(inner, ["lang", "phrase"], "left")
        .where(F.expr(f"_longer IS NULL OR 100BD * _longer < {int(contained_percent)}BD * a"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, then among the firsts of its parts.
    in_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    in_lang = Window.partitionBy("lang").orderBy(*order)
    return (
        kept.withColumn("_place", F.row_number().over(in_part))
        .where(F.col("_place") <= top)
        .withColumn("rank", F.row_number().over(in_lang).cast("bigint"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
