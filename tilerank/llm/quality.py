"""Quality rules: an ordered list of threshold rules, learned from labelled statistics.

Text statistics are counted once per document. The rules are learned by sequential covering
on a bounded sample of labelled rows and become one Spark conditional expression over the
statistics, so that a reader can see why a document was rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import filtered, map_texts, quoted
from .samples import sampled_labels
from .words import repeated_run_words, word_ids

SAMPLE_ROWS = 20_000

STATISTICS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_distinct_words",
    "n_lines",
    "n_upper",
    "n_bangs",
    "n_stops",
    "n_pipes",
    "n_short_words",
    "n_digits",
]

#: What the rules may test: a statistic over another one (or over 1).
MEASURES = {
    "n_words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "short_word_share": ("n_short_words", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NO_WORD_START = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"
_SHORT = 3


def _count(data: bytes, wanted: bytes) -> int:
    return len(data) - len(data.translate(None, wanted))


def text_statistics(data: bytes) -> tuple[int, ...]:
    """The values of STATISTICS for one text in UTF-8."""
    words = data.split()
    ids, distinct = word_ids(words)
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return (
        len(words),
        len(data.translate(None, _NO_WORD_START)),
        _count(data, _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_run_words(ids, len(distinct)),
        len(distinct),
        len(lines),
        _count(data, _UPPER),
        data.count(b"!"),
        data.count(b"."),
        data.count(b"|"),
        sum(map(_SHORT.__ge__, map(len, words))),
        _count(data, _DIGITS),
    )


def with_statistics(docs: DataFrame, text: str = "text", keep=None) -> DataFrame:
    """Rows with the text's STATISTICS beside the ``keep`` columns (all, if not given).

    A null or empty text has zeros. The whole text is counted, however long. A kept column
    with the name of a statistic is replaced by it.
    """

    def compute(texts: list[bytes]):
        rows = [text_statistics(data) for data in texts]
        return list(zip(*rows, strict=True)) if rows else [[] for _ in STATISTICS]

    keep = docs.columns if keep is None else keep
    return map_texts(docs, text, [(name, "bigint") for name in STATISTICS], compute, keep)


def base_failed() -> Column:
    """The fixed rules: too few words, or more than a fifth of them in repeated runs."""
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (words < 10) | (repeated * 100 > words * 20)


@dataclass
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        column = values[self.measure]
        return column >= self.threshold if self.above else column < self.threshold

    def column(self) -> Column:
        measured = measure_column(self.measure)
        return measured >= self.threshold if self.above else measured < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:.6g}"


def measure_column(name: str) -> Column:
    top, bottom = MEASURES[name]
    value = F.col(top).cast("double")
    return value / F.greatest(F.col(bottom), F.lit(1)) if bottom else value


def measure_values(statistics: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {
        name: statistics[top] / (np.maximum(statistics[bottom], 1) if bottom else 1.0)
        for name, (top, bottom) in MEASURES.items()
    }


@dataclass
class DecisionList:
    """Rules in order; a row that satisfies one is bad, a row that satisfies none is good."""

    rules: list[list[Condition]] = field(default_factory=list)

    def good(self) -> Column:
        verdict = None
        for rule in self.rules:
            test = F.lit(True)
            for condition in rule:
                test = test & condition.column()
            verdict = F.when(test, False) if verdict is None else verdict.when(test, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)

    def fired(self) -> Column:
        """Number of the first rule that a row satisfies, from 1; null for a good row."""
        number = F.lit(None).cast("int")
        for place in range(len(self.rules), 0, -1):
            test = F.lit(True)
            for condition in self.rules[place - 1]:
                test = test & condition.column()
            number = F.when(test, F.lit(place)).otherwise(number)
        return number

    def describe(self) -> list[str]:
        return [" and ".join(map(str, rule)) for rule in self.rules]


def _covers(rule: list[Condition], values: dict[str, np.ndarray], n: int) -> np.ndarray:
    covered = np.ones(n, dtype=bool)
    for condition in rule:
        covered &= condition.holds(values)
    return covered


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _grow(values, bad: np.ndarray, cuts: int, longest: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for name, column in values.items():
            column_in, bad_in = column[inside], bad[inside]
            # Candidate thresholds: quantiles of the bad rows and of all rows.
            levels = np.linspace(0, 1, cuts)
            thresholds = np.unique(
                np.concatenate([np.quantile(column_in[bad_in], levels), np.quantile(column_in, levels)])
            )
            for part, sign in ((bad_in, 0), (~bad_in, 1)):
                below = np.searchsorted(np.sort(column_in[part]), thresholds, side="left")
                if sign == 0:
                    p_below = below
                else:
                    n_below = below
            for above in (True, False):
                p = (p0 - p_below) if above else p_below
                n = (n0 - n_below) if above else n_below
                gains = _gain(p.astype(float), n.astype(float), p0, n0)
                at = int(np.argmax(gains))
                if gains[at] > best_gain:
                    best, best_gain = Condition(name, above, float(thresholds[at])), gains[at]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return rule


def learn(
    statistics: dict[str, np.ndarray],
    bad: np.ndarray,
    fold: np.ndarray,
    least_purity: float = 0.9,
    least_rows: int = 8,
    cuts: int = 24,
    longest: int = 4,
    most_rules: int = 24,
) -> DecisionList:
    """Sequential covering: grow a conjunction on two folds, prune it on the third, take out
    what it covers, and go on while the pruned rule is pure enough on rows not used to grow it.

    ``fold`` gives each row a number; rows of fold 0 prune. Ties go to the first measure. A
    list has at most ``most_rules`` rules of at most ``longest`` conditions, whose thresholds are
    ``cuts`` quantiles of a measure: bounds on what is learned, as no row goes for them.
    """
    found = DecisionList()
    values, left = measure_values(statistics), np.ones(len(bad), dtype=bool)
    prune_fold = fold == 0
    while len(found.rules) < most_rules:
        growing, pruning = left & ~prune_fold, left & prune_fold
        if bad[growing].sum() < least_rows:
            break
        grow_values = {name: column[growing] for name, column in values.items()}
        prune_values = {name: column[pruning] for name, column in values.items()}
        rule = _grow(grow_values, bad[growing], cuts, longest)
        if not rule:
            break

        def worth(short, prune_values=prune_values, pruning=pruning) -> float:
            hit = _covers(short, prune_values, int(pruning.sum()))
            p, n = bad[pruning][hit].sum(), (~bad[pruning][hit]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        # The shortest prefix that is as good on the rows kept apart.
        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda short: (worth(short), -len(short)))
        hit = _covers(rule, values, len(bad)) & left
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        apart = hit & prune_fold
        purity = (bad[apart].sum() + 1) / (apart.sum() + 2)
        if p < least_rows or (p + 1) / (p + n + 2) < least_purity or purity < min(
            least_purity, (apart.sum() + 1) / (apart.sum() + 2)
        ):
            break
        found.rules.append(rule)
        left &= ~hit
    return found


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    **options,
) -> DecisionList:
    """Learn a decision list from at most ``sample_rows`` labelled documents.

    The sample holds the labels whose doc_id has the smallest hashes, one row for each, so it
    is the same in each run and no larger for a larger corpus; its statistics are the only
    thing the driver sees. Of rows that share a doc_id the one with the smallest statistics
    teaches. Rows without a label or doc_id teach nothing; without any labelled row the list
    is empty. The ``options`` are those of ``learn``.
    """
    # At most sample_rows narrow rows: safe to broadcast.
    sample = sampled_labels(labels, "quality", sample_rows)
    labelled = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(quoted(text)).alias("_text")
    ).join(F.broadcast(sample), "doc_id")
    one = (
        with_statistics(labelled, "_text", ["doc_id", "label"])
        .groupBy("doc_id", "label")
        .agg(F.min(F.struct(*STATISTICS)).alias("_first"))
        .select("doc_id", "label", "_first.*")
    )
    rows = one.toArrow().to_pandas().sort_values("doc_id", ignore_index=True)
    if not len(rows):
        return DecisionList()
    statistics = {name: rows[name].to_numpy(dtype=np.float64) for name in STATISTICS}
    fold = np.arange(len(rows)) % 3
    return learn(statistics, rows["label"].to_numpy() == 0, fold, **options)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", keep=None) -> DataFrame:
    """Rows with STATISTICS, ``base_failed``, ``rule`` (which one fired) and ``kept``."""
    counted = with_statistics(docs, text, keep)
    return (
        counted.withColumn("base_failed", base_failed())
        .withColumn("rule", rules.fired())
        .withColumn("kept", ~F.col("base_failed") & rules.good())
    )


def filter_documents(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs`` and nothing else.

    Columns of ``docs`` that are named like a statistic are kept as they are.
    """
    return filtered(docs, text, lambda rows, body, keep: judge(rows, rules, body, keep).where("kept"))
