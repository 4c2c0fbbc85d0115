"""Chat formatting by a template that is treated as a black box.

A template is any function from turns to one string. A turn's span is found by rendering the
turns up to it and comparing with what the turns before it gave; if the earlier output is not
the beginning of the later one, the template rewrites history, and that is an error.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import quoted

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

ASSISTANT = "assistant"

_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
# Stands for a text while its place is looked for; private characters, no control string.
_PROBE = "\ue000\uf8ff\ue001"


class RewritesHistory(ValueError):
    """Later turns change how earlier turns are rendered, or reach back too far."""


def escape(text: str) -> str:
    """Break control strings in a text with backslashes; ``unescape`` takes them out again.

    ``</s>`` becomes ``<\\/s>``, a backslash two.
    """
    return _CONTROL.sub(lambda found: "\\\\" if found[0] == "\\" else found[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruction_template(turns: list[Turn]) -> str:
    """``<s>[INST] role, line end, text [/INST]`` and, for the assistant, `` text </s>``."""
    parts = []
    for role, text in turns:
        if role == ASSISTANT:
            parts.append(f" {escape(text)} </s>")
        else:
            named = escape(role).replace("\n", "\\\n")
            parts.append(f"<s>[INST] {named}\n{escape(text)} [/INST]")
    return "".join(parts)


_TURN = re.compile(
    r"<s>\[INST\] (?P<role>(?:[^\\\n]|\\.)*)\n(?P<text>.*?) \[/INST\]| (?P<answer>.*?) </s>", re.DOTALL
)


def read_back(formatted: str) -> list[Turn]:
    """The turns that ``instruction_template`` was given, from its output alone."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        if found["answer"] is not None:
            turns.append((ASSISTANT, unescape(found["answer"])))
        else:
            turns.append((unescape(found["role"]), unescape(found["text"])))
        at = found.end()
    return turns


@dataclass
class Span:
    """A rendered turn, and where its text lies in it."""

    output: str
    begin: int
    end: int


def _grown(before: str, after: str, turn: int) -> str:
    if not after.startswith(before):
        raise RewritesHistory(f"turn {turn} changes what was rendered before it")
    return after[len(before) :]


def _span(held: list[Turn], turn: Turn, before: str, template: Template, number: int) -> tuple[Span, str]:
    """The span of ``turn`` after ``held``, which are rendered as ``before``, and all of it rendered."""
    after = template([*held, turn])
    output = _grown(before, after, number)
    probed = _grown(before, template([*held, (turn[0], _PROBE)]), number)
    begin = probed.find(_PROBE)
    if begin < 0:
        begin = end = len(output)  # this template leaves the text out
    else:
        end = len(output) - (len(probed) - begin - len(_PROBE))
    return Span(output, begin, end), after


class _Recent:
    """Spans from the last turns alone: when ``2 * window`` are held, the first half goes, and
    the last turn must look the same without it, else the template reaches back too far."""

    def __init__(self, template: Template, window: int):
        self.template, self.window = template, window
        self.held: list[Turn] = []
        self.before = ""

    def add(self, number: int, turn: Turn) -> Span:
        span, self.before = _span(self.held, turn, self.before, self.template, number)
        self.held.append(turn)
        if len(self.held) >= 2 * self.window:
            self.held = self.held[self.window :]
            self.before = self.template([*self.held])
            if _grown(self.template(self.held[:-1]), self.before, number) != span.output:
                raise RewritesHistory(f"turn {number} depends on turns more than {self.window} before it")
        return span


def incremental_spans(
    turns: Iterable[Turn], template: Template, window: int | None = None
) -> Iterator[Span]:
    """One Span per turn; joined, their outputs are the formatted conversation.

    The template is a black box, so each prefix of the conversation, whatever its length, is
    rendered and compared with the one before: a template that ever changes what it said is an
    error. That is work in proportion to the conversation for each of its turns.

    A given ``window`` promises that the template reaches back no further. Then only the last
    turns, ``2 * window`` at most, are held and rendered, and a template that is seen to break
    the promise is an error.
    """
    if window is not None:
        recent = _Recent(template, window)
        for number, turn in enumerate(turns):
            yield recent.add(number, turn)
        return
    held: list[Turn] = []
    before = ""
    for number, turn in enumerate(turns):
        span, before = _span(held, turn, before, template, number)
        held.append(turn)
        yield span


def _spans(template: Template, window: int | None):
    names = ["conv_id", "turn_no", "role", "output", "span_start", "text_start", "text_end", "loss"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by conversation and turn, in batches that may end anywhere."""

        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(3)]
                yield from zip(*columns, strict=True)

        out: list[list] = [[] for _ in names]
        size = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(values, type=kind) for values, kind in zip(out, kinds, strict=True)], names=names
            )
            for values in out:
                values.clear()
            return made

        stream = rows()
        row = next(stream, None)
        while row is not None:
            conversation = row[0]
            role_of: deque[str] = deque()

            def turns(conversation=conversation, role_of=role_of) -> Iterator[Turn]:
                nonlocal row
                while row is not None and row[0] == conversation:
                    role, text = row[1] or "", row[2] or ""
                    role_of.append(role)
                    row = next(stream, None)
                    yield role, text

            start = 0
            for number, span in enumerate(incremental_spans(turns(), template, window)):
                role = role_of.popleft()
                values = (
                    conversation,
                    number,
                    role,
                    span.output,
                    start,
                    start + span.begin,
                    start + span.end,
                    role == ASSISTANT,
                )
                start += len(span.output)
                size += len(span.output)
                for held, value in zip(out, values, strict=True):
                    held.append(value)
                if len(out[0]) >= 4096 or size >= 1 << 22:
                    size = 0
                    yield flush()
        if out[0]:
            yield flush()

    return run


def format_conversations(
    conversations: DataFrame,
    template: Template = instruction_template,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    window: int | None = None,
) -> DataFrame:
    """One row per turn: ``conv_id``, ``turn_no`` (from 0), ``role``, ``output`` (what the
    turn adds to the formatted conversation), ``span_start``, ``text_start`` and ``text_end``
    (code points of the formatted conversation, end exclusive), and ``loss``: whether the
    text is the assistant's.

    Turns are ordered by ``turn``, ties by role and text, nulls first; repeated rows are turns
    of their own. A null role or text is empty, rows without a conv_id are one conversation.
    Within a partition the result is ordered by conversation and turn. A conversation goes
    through one task, which holds its turns, as the template is to be given all of them; with
    a ``window``, see ``incremental_spans``, it holds ``2 * window``.
    """
    rows = conversations.select(
        F.col(quoted(conv_id)).cast("bigint").alias("conv_id"),
        F.col(quoted(role)).cast("string").alias("role"),
        F.col(quoted(text)).cast("string").alias("text"),
        F.col(quoted(turn)).cast("bigint").alias("turn"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        _spans(template, window),
        "conv_id bigint, turn_no bigint, role string, output string, span_start bigint,"
        " text_start bigint, text_end bigint, loss boolean",
    )
