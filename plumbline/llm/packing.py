"""Bounded-space online packing of verbatim entries into context windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.vocabulary import vocabulary
from plumbline.session import Scratch

#: Partitions whose leftover windows one merge task takes: at most 32 x open_windows windows.
MERGE_GROUP = 32

_COLUMNS = (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("entry_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("ids", "binary"))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Window:
    __slots__ = ("sequence_id", "used", "pieces")

    def __init__(self, sequence_id: int):
        self.sequence_id, self.used, self.pieces = sequence_id, 0, []

    def rows(self, closed: bool) -> Iterator[tuple]:
        offset = 0
        for entry_id, start, ids, total in self.pieces:
            yield entry_id, start, len(ids), _crc(ids), total, self.sequence_id, offset, None if closed else ids.astype("<u4").tobytes()
            offset += len(ids)


class _Packer:
    """Best fit into at most ``open_windows`` windows; what it returns from ``place`` is full or given up."""

    def __init__(self, context: int, open_windows: int, min_cut: int, first_sequence: int):
        self._context, self._most, self._min_cut, self._next, self.open = context, open_windows, min_cut, first_sequence, []

    def _new(self) -> _Window:
        self._next += 1
        return _Window(self._next - 1)

    def _put(self, window: _Window, piece: tuple, length: int) -> tuple:
        entry_id, start, ids, total = piece
        window.pieces.append((entry_id, start, ids[:length], total))
        window.used += length
        return entry_id, start + length, ids[length:], total

    def place(self, piece: tuple) -> Iterator[_Window]:
        while len(piece[2]):
            length = len(piece[2])
            if length >= self._context:
                window = self._new()
                piece = self._put(window, piece, self._context)
                yield window
                continue
            fits = [w for w in self.open if self._context - w.used >= length]
            if fits:
                window = max(fits, key=lambda w: w.used)
                piece = self._put(window, piece, length)
            elif len(self.open) < self._most:
                window = self._new()
                self.open.append(window)
                piece = self._put(window, piece, length)
            else:
                window = max(self.open, key=lambda w: w.used)
                gap = self._context - window.used
                if gap >= self._min_cut:
                    piece = self._put(window, piece, gap)
                self.open.remove(window)
                yield window
                continue
            if window.used == self._context:
                self.open.remove(window)
                yield window

    def finish(self) -> Iterator[_Window]:
        """The open windows poured together: all but the last are full."""
        left, self.open = sorted(self.open, key=lambda w: -w.used), []
        window = self._new()
        for old in left:
            for piece in old.pieces:
                while len(piece[2]):
                    piece = self._put(window, piece, min(len(piece[2]), self._context - window.used))
                    if window.used == self._context:
                        yield window
                        window = self._new()
        if window.used:
            yield window


def _sequence_base(level: int, part: int) -> int:
    """4 bits for the merge level, 27 for the partition, 32 for the window within it."""
    return (level << 59) | (part << 32)


def pack_entries(
    entries: DataFrame, vocabulary_path: str, *, context: int = 1024, open_windows: int = 16, min_cut: int = 8, end_id: int = 0
) -> DataFrame:
    """Pieces of all entries in sequences of at most ``context`` tokens.

    An entry's tokens are the ids of its whole ``exact_text`` as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them (a special
    token that stands in the text is that token) and then ``end_id``. Each input partition keeps
    ``open_windows`` windows: a piece goes into the fullest window that still holds it; when none does and no further
    window may be opened, the fullest is completed with the beginning of the piece (if its gap is at
    least ``min_cut`` tokens; smaller gaps stay padding) and emitted. Entries longer than a window are cut into
    full windows first. Leftover windows carry their ids and are merged over groups of 32 partitions, again best fit,
    until one group is left, whose windows are poured together. So padding is less than ``min_cut`` tokens per
    sequence, and one last sequence. Memory per task is ``open_windows`` windows, whatever the partition holds.

    Result, one row per piece: ``entry_id``, ``start`` (tokens of its entry before it), ``length``, ``ids_crc32`` (of the
    little-endian unsigned 32-bit ids), ``entry_tokens``, ``sequence_id``, ``offset`` (its place in the sequence).

    Defined cases: null and empty texts are one token, ``end_id``; repeated rows are packed once per row; a null id
    stays null; an empty table gives no pieces. Other columns are not carried. The pieces are stored
    once in the shared folder, so that a lost task cannot renumber sequences that others have read.
    """
    spark, id_type = entries.sparkSession, entries.schema["entry_id"].dataType
    schema = T.StructType([T.StructField("entry_id", id_type), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in _COLUMNS)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, part = vocabulary(vocabulary_path), TaskContext.get().partitionId()
        packer = _Packer(context, open_windows, min_cut, _sequence_base(0, part))
        for batch in batches:
            out = []
            for entry_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(vocab.encode(text.as_py() or ""), np.uint32(end_id))
                for window in packer.place((entry_id, 0, ids, len(ids))):
                    out += window.rows(True)
            yield from _batches(out, arrow)
        yield from _batches([row for window in packer.open for row in window.rows(False)], arrow)

    def merge(level: int, last: bool):
        def merged(table: pa.Table) -> pa.Table:
            # Ids stay Arrow values throughout: long ids beside null ones are not numbers of a data frame.
            table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            packer = _Packer(context, open_windows, min_cut, _sequence_base(level, table.column("part")[0].as_py()))
            columns = (table.column(c).to_pylist() for c in ("entry_id", "start", "ids", "entry_tokens"))
            out = []
            for entry_id, start, ids, total in zip(*columns, strict=True):
                for window in packer.place((entry_id, start, np.frombuffer(ids, "<u4").astype(np.uint32), total)):
                    out += window.rows(True)
            for window in packer.finish() if last else packer.open:
                out += window.rows(last)
            return pa.Table.from_batches(_batches(out, arrow), schema=arrow)

        return merged

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    shown = [c for c in schema.names if c != "ids"]
    with Scratch(spark) as scratch:
        stored = scratch.freeze(entries.select("entry_id", F.col("exact_text")).mapInArrow(pack, schema))
        done = [stored.where("ids is null").select(shown)]
        part = F.shiftright("sequence_id", 32).bitwiseAND(F.lit((1 << 27) - 1))
        level, parts = 0, (stored.agg(F.max(part)).first()[0] or 0) + 1
        while True:
            level, parts = level + 1, -(-parts // MERGE_GROUP)
            left = stored.where("ids is not null").withColumn("part", F.floor(part / MERGE_GROUP).cast("long"))
            stored = scratch.freeze(left.groupBy("part").applyInArrow(merge(level, parts == 1), schema))
            done.append(stored.where("ids is null").select(shown))
            if parts == 1:
                break
        scratch.keep()
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    return out


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
