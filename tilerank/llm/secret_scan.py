"""Secret scans: all rules in one pass over the bytes of a text.

One combined automaton reads each byte once and tells where a match of some rule ends. Only
there, a rule's own small automata find the leftmost beginning and the longest end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .arrow import map_texts, quoted
from .automaton import Automaton, match_automaton, origin_automaton, search_automaton


@dataclass(frozen=True)
class Rule:
    """``head`` and then ``body``, over ASCII; a match counts if what follows its longest head
    has ``least`` bytes or more.

    Matches of a rule are leftmost, longest and do not overlap; one that does not count still
    uses up its bytes. ``any_case``: letters of the patterns stand for both cases.
    """

    kind: str
    head: str
    body: str
    least: int
    any_case: bool = False


# The three kinds asked for, and known shapes of keys. Counted repeats are kept
# short, as they multiply the states of the combined automaton; ``least`` does the rest.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        r"[A-Za-z0-9+/_.=-]+",
        6,
        True,
    ),
    Rule("access", "", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", "", r"[0-9a-f]{6,}", 24),
)
MORE_RULES = (
    Rule("github", "", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("google", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", "", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("pem", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
RULES = BASE_RULES + MORE_RULES


def _longest(automaton: Automaton, data: bytes, begin: int) -> int:
    """Where the longest match from ``begin`` on ends; -1 if there is none."""
    moves, classes = automaton.moves, automaton.classes
    telling, dead = automaton.telling, automaton.dead
    state, end = automaton.start, -1
    for place in range(begin, len(data)):
        state = moves[state + classes[data[place]]]
        if state >= telling:
            end = place + 1
        elif state == dead:
            break
    return end


class Scanner:
    """The compiled rules. Small: it is built once and goes to the executors with the task."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = tuple(rules)
        plain = [(rule.head + rule.body, rule.any_case) for rule in rules]
        self.search = search_automaton(plain)
        self.match = [match_automaton(rule) for rule in plain]
        self.origin = [origin_automaton(rule) for rule in plain]
        self.by_mark = [
            [r for r in range(len(plain)) if mark >> r & 1] for mark in self.search.marks
        ]
        self.head = [match_automaton((rule.head, rule.any_case)) if rule.head else None for rule in rules]

    def _resolve(self, number: int, data: bytes, low: int, at: int) -> tuple[int, int] | None:
        """The leftmost longest match of a rule that begins at ``low`` or later, ``at`` being
        where its first match from there on ends at the earliest."""
        back, begins = self.origin[number], []
        state, place = back.start, at
        if state >= back.telling:
            begins.append(place)
        while place > low:
            place -= 1
            state = back.moves[state + back.classes[data[place]]]
            if state == back.dead:
                break
            if state >= back.telling:
                begins.append(place)
        for begin in reversed(begins):
            end = _longest(self.match[number], data, begin)
            if end > begin:
                return begin, end
        return None

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule number) of the matches that count, ordered by start, then rule."""
        search = self.search
        moves, telling, width = search.moves, search.telling, search.width
        state, by_mark, found = search.start, self.by_mark, []
        resume = [0] * len(self.rules)
        for at, kind in enumerate(data.translate(search.classes), 1):
            state = moves[state + kind]
            if state >= telling:
                for number in by_mark[state // width]:
                    if at <= resume[number]:
                        continue
                    match = self._resolve(number, data, resume[number], at)
                    if match is None:
                        continue
                    begin, end = match
                    resume[number] = end
                    head = self.head[number]
                    after = max(begin, _longest(head, data, begin)) if head else begin
                    if end - after >= self.rules[number].least:
                        found.append((begin, end, number))
        found.sort(key=lambda span: (span[0], span[2]))
        return found

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        raw = self.byte_spans(data)
        if not raw or data.isascii():
            return [(self.rules[number].kind, begin, end) for begin, end, number in raw]
        points, last, before = {}, 0, 0
        for place in sorted({p for begin, end, _ in raw for p in (begin, end)}):
            before += len(data[last:place].decode("utf-8", "replace"))
            points[place], last = before, place
        return [(self.rules[n].kind, points[begin], points[end]) for begin, end, n in raw]


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans``: ``kind:start:end`` of all secrets in the whole text, by
    start, then in the order of the rules, joined by commas. Positions are code points, ends
    exclusive. Null and empty texts, and texts without a secret, have the empty string.
    """
    scanner = Scanner(rules)

    def compute(texts: list[bytes]):
        return [[",".join(f"{k}:{a}:{b}" for k, a, b in scanner.spans(data)) for data in texts]]

    return map_texts(docs, text, [("spans", "string")], compute, keep)


def _redacted(scanner: Scanner, data: bytes) -> bytes:
    parts, last = [], 0
    for begin, end, number in scanner.byte_spans(data):
        if end <= last:
            continue
        if begin >= last:
            parts += [data[last:begin], b"[" + scanner.rules[number].kind.encode() + b"]"]
        last = end
    return b"".join([*parts, data[last:]]) if parts else data


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with each secret in ``text`` replaced by its kind in brackets.

    Overlapping secrets become one replacement, named after the first. Null texts stay null;
    the other columns, their names and their order stay as they are.
    """
    scanner = Scanner(rules)

    def compute(texts: list[bytes]):
        return [[_redacted(scanner, data).decode("utf-8", "replace") for data in texts]]

    # Under plain names, which clash with nothing; the old text does not come back.
    names = docs.columns
    plain = [f"_column{place}" for place in range(len(names))]
    body = plain[names.index(text)]
    rows = docs.toDF(*plain).withColumn("_has_text", F.col(body).isNotNull())
    others = [name for name in plain if name != body]
    made = map_texts(rows, body, [("_clean", "string")], compute, [*others, "_has_text"])
    clean = F.when(F.col("_has_text"), F.col("_clean")).alias(body)
    return made.select(*[clean if name == body else name for name in plain]).toDF(*names)


def with_length(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with its column ``length``, if it has one, counted anew in code points."""
    if length not in docs.columns:
        return docs
    counted = F.length(F.col(quoted(text))).cast(docs.schema[length].dataType)
    return docs.withColumn(length, counted)
