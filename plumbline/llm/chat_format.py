"""Turns located in the output of a chat template by rendering successive prefixes.

The project keeps no conversation records (its verbatim entries are single user messages), so this operator is general: it
takes messages (``conv_id``, ``turn``, ``role``, ``text``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]  # role, text
Template = Callable[[Sequence[Message]], str]

#: Turns that a rendered prefix holds at most where the template is declared local; later prefixes begin at the turn before.
BLOCK = 16
END = "</turn>"
_COLON = "\\:"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: One turn in the output; the text runs to the first end mark that is not escaped.
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.DOTALL)


def escaped(text: str) -> str:
    """Reversible: a backslash before every backslash, turn mark and end mark of the text."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(messages: Sequence[Message]) -> str:
    """``### role: text</turn>`` and a line end per turn; control strings inside role and text are escaped."""
    return "".join(f"### {escaped(role).replace(':', _COLON)}: {escaped(text)}{END}\n" for role, text in messages)


def read_back(output: str) -> list[Message]:
    """The messages of an output of ``turn_template``."""
    found, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescaped(m.group(1)), unescaped(m.group(2))))
        at = m.end()
    return found


def _shared(x: str, y: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if x[:middle] == y[:middle] else (low, middle)
    return low


@dataclass
class Located:
    """A turn's rendered piece, where it starts in the output of its prefix and where its content stands in it; ``rewrote`` if
    it changed what was rendered before."""

    piece: str
    start: int
    content_start: int
    content_end: int
    rewrote: bool


class TurnLocator:
    """Feeds turns one by one to a black-box template and compares each output with the one before.

    A turn's piece is what its prefix adds to the output of the prefix without it. Its content is bounded by rendering the same
    prefix with two probe texts that share neither end: what their pieces have in common at either end is the template's.
    A template that changes the earlier output when a turn is added rewrites history; the piece is then what
    follows the common beginning, and the turn is marked. Prefixes begin at the first turn, because no output of a few turns
    shows what a template does with more of them. ``local`` is the caller's word that a turn is rendered alike whatever is
    before it: then prefixes are at most ``BLOCK`` turns long, and a longer conversation goes on from its last turn.
    """

    def __init__(self, template: Template, local: bool = False):
        self._template, self._local, self._held, self._before, self._passed = template, local, [], "", 0

    def add(self, role: str, text: str) -> Located:
        held = [*self._held, (role, text)]
        output = self._template(held)
        piece, rewrote = self._piece(output, self._before)
        begin = len(output) - len(piece)
        probes = [self._template([*self._held, (role, probe)]) for probe in ("a", "b")]
        start = _shared(*probes)
        tail = _shared(probes[0][start + 1 :][::-1], probes[1][start + 1 :][::-1])
        end = len(output) - tail
        located = Located(piece, self._passed + begin, start - begin, max(start, end) - begin, rewrote)
        if self._local and len(held) >= BLOCK and self._piece(self._template(held[-2:]), self._template(held[-2:-1])) == (piece, False):
            held, whole = held[-1:], len(output)
            output = self._template(held)
            self._passed += whole - len(output)
        self._held, self._before = held, output
        return located

    @staticmethod
    def _piece(output: str, before: str) -> tuple[str, bool]:
        return (output[len(before) :], False) if output.startswith(before) else (output[_shared(output, before) :], True)


_TURNS = "conv_id {id}, turn {turn}, role string, piece string, start long, content_start long, content_end long, loss boolean, rewrote boolean"


def located_turns(messages: DataFrame, *, template: Template = turn_template, loss_roles: tuple[str, ...] = ("assistant",), local: bool = False) -> DataFrame:
    """Per message: its rendered ``piece``, where it ``start``\\ s in the output up to its turn, its content's
    ``content_start`` and ``content_end`` there (code points), ``loss`` (content under the loss mask) and ``rewrote``.

    Conversations are dealt by ``conv_id`` and streamed in order of (turn, role, text). Every turn is rendered with all turns
    before it, so memory is a conversation and rendering grows with the square of its turns. ``local`` declares a template that
    renders a turn alike whatever is before it, as ``turn_template`` does: then memory is a block of turns, whatever a
    conversation holds, and rendering is linear. The result keeps this order within its partitions.

    Defined cases: a null text is empty, a null role is an empty one; messages without ``conv_id`` are one conversation; equal
    turns and repeated rows are turns of their own, in order of role and text; null turns come first; an empty table gives an
    empty table. Other columns are not read.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = _TURNS.format(id=rows.schema["conv_id"].dataType.simpleString(), turn=rows.schema["turn"].dataType.simpleString())

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, locator = object(), None
        for batch in batches:
            columns = [[] for _ in range(6)]
            for conv_id, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv_id != now:
                    now, locator = conv_id, TurnLocator(template, local)
                at = locator.add(role, text)
                values = (at.piece, at.start, at.start + at.content_start, at.start + at.content_end, role in loss_roles, at.rewrote)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], names=[p.split()[0] for p in schema.split(", ")])

    return ordered.mapInArrow(locate, schema)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``located_turns``, read back from the rendered pieces: ``n_turns``, ``turns_sha256`` (role, line end, text,
    line end per turn), ``loss_chars`` and ``loss_sha256`` (all text under the loss mask), ``formatted_chars``.

    For outputs of ``turn_template``. Turns must come as ``located_turns`` leaves them: they are folded as a stream, so no
    conversation is gathered. A piece that does not read back as one turn is refused.
    """
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, id_type = None, None
        for batch in batches:
            id_type, done = batch.column(0).type, []
            names = ("conv_id", "piece", "start", "content_start", "content_end", "loss")
            for conv_id, piece, start, low, high, loss in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        done.append(_digest_row(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ((role, text),) = read_back(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    masked = unescaped(piece[low - start : high - start])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            yield from _digest_batch(done, id_type)
        if state is not None:
            yield from _digest_batch([_digest_row(state)], id_type)

    return turns.mapInArrow(fold, schema)


def _digest_row(state: list) -> tuple:
    conv_id, n, turns, chars, loss, formatted = state
    return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), formatted


def _digest_batch(rows: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    if rows:
        types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
