"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) to one string; nothing else is known of it. Successive prefixes of
a conversation are rendered, and where an output begins with the one before, the rest is the span of the new turn. A
template whose output for a longer prefix does not begin with the shorter one rewrites history, which is reported. The
place of a text within its span is found by rendering the turn once more with a probe for its text.

Rows are streamed in order of turns. Of a template that promises to render a turn alike whatever is far behind it (a
true attribute `restarts`, as tagged() has) a conversation of any length takes bounded memory: after BLOCK turns
prefixes start anew at a block; the turn at the border is rendered both ways, and where the two differ whole prefixes
are used instead. Of any other template whole prefixes are rendered, in time that grows with the square of the turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns from which prefixes are rendered at once.
BLOCK = 128
PROBE = "\ue000probe\ue001"
#: How a > within a role is written; escape() leaves no single backslash before a g.
_CLOSE = "\\g"


def escape(text: str) -> str:
    """No control string of the template can stand in an escaped text: each begins with < or [."""
    return re.sub(r"([\\<\[])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\<\[])", r"\1", text)


def tagged(turns: list[Turn]) -> str:
    """The template of this library: <turn role> text </turn>, with role and text escaped."""
    return "".join(f"<turn {escape(role).replace('>', _CLOSE)}>{escape(text)}</turn>\n" for role, text in turns)


tagged.restarts = True

_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<\[]|\\[\\<\[])*)</turn>\n", re.S)


def read_tagged(output: str) -> list[Turn]:
    """What tagged() has been given."""
    found, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        found.append((_role(m[1]), unescape(m[2])))
        at = m.end()
    return found


def _role(escaped: str) -> str:
    return re.sub(r"\\([\\<\[g])", lambda m: ">" if m[1] == "g" else m[1], escaped)


@dataclass
class Incremental:
    """Renders turns one after the other. rewrites: how often an output did not begin with the one before.

    restarts: the template promises to render later turns alike without older history, which then starts anew every
    BLOCK turns once both renderings have been compared; else whole prefixes are rendered.
    """

    template: Template
    history: list[Turn] = field(default_factory=list)
    before: str = ""
    rewrites: int = 0
    whole: bool = False
    restarts: bool = True

    def _span(self, turn: Turn) -> tuple[str, bool]:
        now = self.template([*self.history, turn])
        return (now[len(self.before) :], True) if now.startswith(self.before) else (now, False)

    def feed(self, role: str, text: str) -> tuple[str, int, int]:
        """The span of the turn, and where the text begins and ends in it (-1 where the probe can't tell)."""
        if self.restarts and len(self.history) >= BLOCK and not self.whole:
            far, _ = self._span((role, text))
            last = self.history[-1:]
            near = Incremental(self.template, last, self.template(last))
            if near._span((role, text)) == (far, True):
                self.history, self.before = last, near.before
            else:
                self.whole = True
        span, grows = self._span((role, text))
        self.rewrites += not grows
        start, end = self._place(role, span)
        self.history.append((role, text))
        self.before = self.before + span if grows else span
        return span, start, end

    def _place(self, role: str, span: str) -> tuple[int, int]:
        probed, _ = self._span((role, PROBE))
        head, mark, tail = probed.partition(PROBE)
        if mark and span.startswith(head) and span.endswith(tail) and len(head) + len(tail) <= len(span):
            return len(head), len(span) - len(tail)
        return -1, -1


_PIECE = "conv_id long, place long, role string, piece string, start long, loss_start long, loss_end long, rewrites long"
_TYPES = {"long": pa.int64(), "string": pa.string()}
_COLUMNS = [(part.split()[0], _TYPES[part.split()[1]]) for part in _PIECE.split(", ")]


def _renderer(template: Template, learned: str):
    restarts = getattr(template, "restarts", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, state, place, at = object(), Incremental(template, restarts=restarts), 0, 0
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conv_id != conversation:
                    conversation, state, place, at = conv_id, Incremental(template, restarts=restarts), 0, 0
                span, start, end = state.feed(role or "", text or "")
                loss = (at + start, at + end) if role == learned and start >= 0 else (None, None)
                rows.append((conv_id, place, role or "", span, at, *loss, state.rewrites))
                place, at = place + 1, at + len(span)
            columns = list(zip(*rows, strict=True)) or [[] for _ in _COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])

    return run


def render(conversations: DataFrame, template: Template = tagged, learned: str = "assistant") -> DataFrame:
    """A row for each turn, ordered within each conversation: its piece of the output and the span of its loss.

    piece joined over place is the formatted conversation; start is where it begins there, and loss_start to loss_end
    the text of a turn of the learned role (null for others). rewrites counts how often the template has rewritten
    history so far; pieces then are whole outputs. Turns sort by turn, role and text, nulls first; repeated rows are
    turns of their own. Null role or text is empty, and a null conv_id is a conversation. Other columns are not looked at.
    A template without a true attribute `restarts` (see Incremental) gets every prefix whole.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_renderer(template, learned), _PIECE)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [_TYPES[part.split()[1]] for part in _DIGEST.split(", ")]
    names = [part.split()[0] for part in _DIGEST.split(", ")]
    conversation, state = object(), None

    def closed() -> list[tuple]:
        if state and state["unread"]:
            raise state["unread"]
        return [] if state is None else [(conversation, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["rewrites"])]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[] for _ in types], types, strict=True)], names=names)

    for batch in batches:
        rows = []
        for conv_id, piece, start, loss_start, loss_end, rewrites in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "piece", "start", "loss_start", "loss_end", "rewrites")], strict=True):
            if state is None or conv_id != conversation:
                rows += closed()
                conversation, state = conv_id, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "rewrites": 0, "unread": None}
            if rewrites:
                raise ValueError(f"the template rewrites turns of conversation {conv_id}: its pieces are whole outputs, which can't be read one after the other")
            try:
                read = read_tagged(piece)
            except ValueError as error:  # raised when the conversation ends, as a later turn may show that the template rewrites
                read, state["unread"] = [], state["unread"] or error
            for role, text in read:
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss_start is not None:
                learned = unescape(piece[loss_start - start : loss_end - start])
                state["loss"].update(learned.encode("utf-8", "surrogatepass"))
                state["loss_chars"] += len(learned)
            state["chars"] += len(piece)
            state["rewrites"] = rewrites
        yield batch_of(rows)
    yield batch_of(closed())


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation what is read back from pieces of the template tagged(); keeps to the order of render().

    Pieces of a template that has rewritten history are refused, as they overlap; so are pieces that can't be read.
    """
    return rendered.mapInArrow(_digest, _DIGEST)
