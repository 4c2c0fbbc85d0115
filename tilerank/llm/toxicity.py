"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is the logistic of a sum of word weights, a word's weight the sum of the
weights of the word itself and of its beginnings. A document is toxic if any sentence is: its score is the
noisy-or of its sentences' scores. Only that document score meets a label in training, and
the sentence scores that come out of it locate what is offending.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import filtered, map_texts, quoted
from .samples import sampled_labels, sampled_texts

SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 64 << 20
BUCKETS = 1 << 20
MASK = BUCKETS - 1
MEMO_WORDS = 200_000
FOLDS = 5

# Characters that end a sentence become a line feed, other punctuation a space.
_ENDS = b".!?\n\r"
_MARKS = b",;:\"'()[]{}%*$&#|<>=+~^\\/_-\t\x0b\x0c"
_TABLE = bytes(
    0x0A if c in _ENDS else 0x20 if c in _MARKS else c for c in range(256)
)
_SENTENCE = re.compile(rb"[^.!?\n\r]+")


def normal(data: bytes) -> bytes:
    return data.decode("utf-8", "replace").lower().encode().translate(_TABLE)


def sentences(data: bytes) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    return [words for line in normal(data).split(b"\n") if (words := line.split())]


def word_features(word: bytes) -> list[int]:
    """Buckets of the whole word and of its beginnings of 3 to 6 bytes."""
    return [
        crc32(b" " + word) & MASK,
        crc32(word[:3]) & MASK,
        crc32(word[:4]) & MASK,
        crc32(word[:5]) & MASK,
        crc32(word[:6]) & MASK,
    ]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a row is kept out of training: one in FOLDS, by its identifier."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class ToxicityModel:
    """``weights`` per bucket; a sentence of unknown words gets the logistic of ``bias``."""

    weights: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self.weights, self.bias)


class Scorer(dict):
    """Weights of the words met so far; emptied when it holds MEMO_WORDS."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        told = np.flatnonzero(weights)
        self.known, self.bias = dict(zip(told.tolist(), weights[told].tolist(), strict=True)), bias

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        known = self.known
        self[word] = value = sum([known[i] for i in word_features(word) if i in known])
        return value

    def sentence_logits(self, data: bytes) -> np.ndarray:
        weight = self.__getitem__
        return np.array(
            [self.bias + sum(map(weight, words)) for words in sentences(data)], dtype=np.float64
        )

    def score(self, data: bytes) -> float:
        """Noisy-or over the sentences; 0 for a text without words."""
        logits = self.sentence_logits(data)
        return float(-np.expm1(-np.logaddexp(0.0, logits).sum()))

    def spans(self, data: bytes, least: float) -> list[tuple[int, int, float]]:
        """Sentences that score ``least`` or more: start and end in code points, score."""
        found = []
        for match in _SENTENCE.finditer(data):
            words = normal(match[0]).split()
            if not words:
                continue
            logit = self.bias + sum(map(self.__getitem__, words))
            score = 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))
            if score >= least:
                start = len(data[: match.start()].decode("utf-8", "replace"))
                found.append((start, start + len(match[0].decode("utf-8", "replace")), float(score)))
        return found


def learn(
    texts: list[bytes],
    toxic: np.ndarray,
    epochs: int = 250,
    rate: float = 0.4,
    shrink: float = 1e-4,
    least_documents: int = 3,
    least_deviation: float = 4.0,
) -> ToxicityModel:
    """Fit sentence weights to document labels by AdaGrad on the noisy-or likelihood.

    Buckets keep the weight 0 if fewer than ``least_documents`` toxic texts have them, or if
    these are fewer than ``least_deviation`` standard deviations above what chance would
    give. Weights are never negative, as no sentence makes another one harmless, and each
    step shrinks them, so that words which only keep company with telling ones lose theirs.
    """
    numbers: dict[bytes, int] = {}
    token_parts: list[np.ndarray] = []
    sentence_sizes: list[int] = []
    sentence_counts: list[int] = []
    for data in texts:
        lines = sentences(data)
        token_parts.append(
            np.fromiter(
                (numbers.setdefault(word, len(numbers)) for line in lines for word in line), np.int32
            )
        )
        sentence_sizes.extend(map(len, lines))
        sentence_counts.append(len(lines))
    n_sentences = len(sentence_sizes)
    if not n_sentences or toxic.all() or not toxic.any():
        return ToxicityModel(np.zeros(BUCKETS), 0.0 if toxic.any() else -6.0)
    distinct = list(numbers)
    token = np.concatenate(token_parts)
    del numbers, token_parts
    token_sentence = np.repeat(np.arange(n_sentences, dtype=np.int32), sentence_sizes)
    sentence_document = np.repeat(np.arange(len(texts)), sentence_counts)
    feature = np.fromiter((f for word in distinct for f in word_features(word)), np.int32)
    feature_word = np.repeat(np.arange(len(distinct), dtype=np.int32), len(feature) // len(distinct))

    # Toxic and all documents per bucket: each (document, word) once, then its buckets.
    pairs = np.unique(sentence_document[token_sentence] * len(distinct) + token)
    pair_word, pair_toxic = pairs % len(distinct), toxic[pairs // len(distinct)]
    share = toxic.mean()

    def documents(of_words: np.ndarray) -> np.ndarray:
        per_word = np.bincount(of_words, minlength=len(distinct))
        return np.bincount(feature, per_word[feature_word], BUCKETS)

    n_all, n_toxic = documents(pair_word), documents(pair_word[pair_toxic])
    spread = np.sqrt(np.maximum(n_all * share * (1 - share), 1e-9))
    telling = (n_toxic >= least_documents) & (n_toxic - n_all * share >= least_deviation * spread)
    used = telling[feature]
    feature, feature_word = feature[used], feature_word[used]

    truth = toxic[sentence_document]
    weights, bias = np.zeros(BUCKETS), -4.0
    squares, bias_squares = np.full(BUCKETS, 1e-8), 1e-8
    n_documents = len(texts)
    for _ in range(epochs):
        word_weight = np.bincount(feature_word, weights[feature], len(distinct))
        logit = bias + np.bincount(token_sentence, word_weight[token], n_sentences)
        p = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
        none = np.bincount(sentence_document, np.logaddexp(0.0, logit), n_documents)
        some = np.maximum(-np.expm1(-none), 1e-12)[sentence_document]
        slope = np.where(truth, -p * (1.0 - some) / some, p) / n_documents
        by_word = np.bincount(token, slope[token_sentence], len(distinct))
        gradient = np.bincount(feature, by_word[feature_word], BUCKETS) + shrink
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
        np.maximum(weights, 0.0, out=weights)
        step = slope.sum()
        bias_squares += step**2
        bias -= rate * step / np.sqrt(bias_squares)
    return ToxicityModel(weights, float(bias))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    **options,
) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled documents that are not held out.

    The sample holds the labels whose doc_id has the smallest hashes, one text for each, and at
    most ``sample_bytes`` of text (see ``samples``): the same in each run, bounded for any
    corpus. Only texts and ``toxic`` are used. Rows without doc_id or label teach nothing;
    without both classes the model scores all documents alike.
    """
    sample = sampled_labels(labels, "toxic", sample_rows, ~held_out())
    rows = sampled_texts(docs, sample, text, sample_bytes).toArrow().sort_by("doc_id")
    texts = rows["text"].cast("binary").to_pylist()
    return learn(texts, rows["label"].to_numpy() == 1, **options)


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", keep=None) -> DataFrame:
    """``keep`` columns (all, if not given) and the document's ``score``, 0 to 1.

    A null or empty text has no sentence and scores 0. A kept ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def compute(texts: list[bytes]):
        scorer = Scorer(*shared.value)
        return [[scorer.score(data) for data in texts]]

    return map_texts(docs, text, [("score", "double")], compute, docs.columns if keep is None else keep)


def offending_sentences(
    docs: DataFrame, model: ToxicityModel, text: str = "text", keep=("doc_id",), least: float = 0.5
) -> DataFrame:
    """One row per sentence that scores ``least`` or more: ``span_start`` and ``span_end`` in
    code points (end exclusive) and ``span_score``. Texts without one give no row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def compute(texts: list[bytes]):
        scorer = Scorer(*shared.value)
        return [["\n".join(f"{a} {b} {s!r}" for a, b, s in scorer.spans(data, least)) for data in texts]]

    found = map_texts(docs, text, [("_spans", "string")], compute, keep)
    parts = F.split("_span", " ")
    return (
        found.where("_spans <> ''")
        .withColumn("_span", F.explode(F.split("_spans", "\n")))
        .select(
            *[quoted(name) for name in keep],
            parts[0].cast("bigint").alias("span_start"),
            parts[1].cast("bigint").alias("span_end"),
            parts[2].cast("double").alias("span_score"),
        )
    )


def filter_documents(
    docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with the columns of ``docs``."""
    return filtered(
        docs,
        text,
        lambda rows, body, keep: score_documents(rows, model, body, keep).where(F.col("score") < limit),
    )
