"""Delimited files and JSON arrays read in byte ranges, however their records lie across them.

Spark's text source cuts a file into ranges at a separator: line ends for delimited files, closing braces for JSON. Neither
is a border by itself, since both may stand inside quotes, so a range cannot know how it begins. Each range is therefore
first read under every possible beginning and reduced to what it does to the state; the few states, one row per range, are combined in
file order; then every range is cut into records from its true beginning. Only the record that lies across a border is put together by a
shuffle, from one fragment per range.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import freeze

PIECE = "file string, begins long, place long, kind string, text string, cells array<string>"


class Delimited:
    """Records of a delimited file; the state is whether a line begins inside a quoted field."""

    separator, joint, closing = "\n", "\n", ""

    def __init__(self, delimiter: str):
        self.delimiter = delimiter

    def beginnings(self) -> list[tuple]:
        return [(0, 0), (1, 0)]

    def after(self, state: tuple, line: str) -> tuple:
        if '"' not in line and (not state[0] or "\r" not in line):
            return state
        return int(self._inside(line, bool(state[0]))), 0

    def _inside(self, line: str, inside: bool) -> bool:
        """Whether the line ends inside a quoted field. A quote opens a field only at its first place."""
        at = 0
        while True:
            if not inside:
                if line[at : at + 1] == '"':
                    at += 1
                else:
                    ends = [e for e in (line.find(self.delimiter, at), line.find("\r", at)) if e >= 0]
                    if not ends:
                        return False
                    at = min(ends) + 1
                    continue
            at = line.find('"', at)
            if at < 0:
                return True
            inside = line[at + 1 : at + 2] == '"'
            at += 1
            if inside:
                at += 1
            elif line[at : at + 1] == self.delimiter:
                at += 1
            elif at < len(line):
                at += line[at] == "\r"

    def records(self, groups: list[list[str]]) -> Iterator[tuple[str, str | None, list[str] | None]]:
        """Cells of each record of whole lines, by the strict rules of the standard parser."""
        csv.field_size_limit(sys.maxsize)
        text = "".join(line + "\n" for group in groups for line in group)
        try:
            for cells in csv.reader(io.StringIO(text, newline=""), delimiter=self.delimiter, strict=True):
                if cells:  # a blank line is no record
                    yield "record", None, cells
        except csv.Error:
            yield "DATA_PARSE_ERROR", None, None

    def joined(self, fragments: list[str]) -> Iterator[tuple[str, str | None, list[str] | None]]:
        return self.records([["\n".join(fragments)]])

    def is_border(self, state: tuple) -> bool:
        return not state[0]

    def end(self, held: list[str]) -> Iterator[tuple[str, str | None, list[str] | None]]:
        """Lines of a field that is never closed."""
        return self.records([held])


class JsonArray:
    """Objects of a JSON array; the state is whether a chunk begins inside a string, and how many brackets are open."""

    separator, joint, closing = "}", "}", "}"

    def beginnings(self) -> list[tuple]:
        return [(0, 0), (1, 0)]

    def _outside(self, inside: int, chunk: str) -> tuple[int, str]:
        parts = (re.sub(r"(?s)\\.", "", chunk) if "\\" in chunk else chunk).split('"')
        return (inside + len(parts) - 1) % 2, "".join(parts[inside::2])

    def after(self, state: tuple, chunk: str) -> tuple:
        inside, bare = self._outside(state[0], chunk)
        opened = bare.count("{") + bare.count("[") - bare.count("]") - (not inside)
        return inside, state[1] + opened

    def is_border(self, state: tuple) -> bool:
        return state == (0, 1)

    def records(self, groups: list[list[str]]) -> Iterator[tuple[str, str | None, list[str] | None]]:
        """The text of each object, and a code for anything else that stands before it."""
        for group in groups:
            text = "}".join(group) + "}"
            at = text.find("{")
            between = text[:at]
            if between.strip(" \t\r\n") == ",":
                problem = None
            elif between.lstrip(" \t\r\n").startswith("["):
                problem = self._between(between + "0]", 1)
            else:
                problem = self._between("[0" + between + "0]", 2)
            yield problem or "record", text[at:], None

    def joined(self, fragments: list[str]) -> Iterator[tuple[str, str | None, list[str] | None]]:
        return self.records([["}".join(fragments)[:-1]]])

    def end(self, held: list[str]) -> Iterator[tuple[str, str | None, list[str] | None]]:
        """What stands behind the last object: the end of the array and nothing else."""
        text = "}".join(held)
        whole = text.lstrip(" \t\r\n").startswith("[")
        problem = self._between(text if whole else "[0" + text, 0 if whole else 1)
        if problem:
            yield problem, None, None

    @staticmethod
    def _between(text: str, values: int) -> str | None:
        """What is wrong with the text around objects, an object being written as 0."""
        try:
            found = json.loads(text)
        except ValueError:
            return "DATA_PARSE_ERROR"
        return None if len(found) == values else "DATA_JSON_SHAPE"


def _ranges(spark: SparkSession, path: str, separator: str) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(path)
    meta = F.col("_metadata")
    return lines.select(F.col("value").cast("binary").alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("begins"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, list[str] | None]]:
    """Runs of texts of one range with the place of their first row; None where bytes are not UTF-8."""
    files, begins = batch.column("file").to_pylist(), batch.column("begins").to_pylist()
    values, low = batch.column("value").to_pylist(), 0
    for high in range(1, len(values) + 1):
        if high == len(values) or (files[high], begins[high]) != (files[low], begins[low]):
            try:
                yield (files[low], begins[low]), low, [v.decode("utf-8") for v in values[low:high]]
            except UnicodeDecodeError:
                yield (files[low], begins[low]), low, None
            low = high


def _effects(form: Delimited | JsonArray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per range, what it does to each beginning: the state after it, and how far the depth moves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, []

        def row() -> pa.RecordBatch:
            (x, dx), (y, dy) = states
            return pa.RecordBatch.from_pydict({"file": [now[0]], "begins": pa.array([now[1]], pa.int64()), "from_out": [x], "depth_out": [dx], "from_in": [y], "depth_in": [dy]})

        for batch in batches:
            for key, _, texts in _runs(batch):
                if key != now:
                    if now is not None:
                        yield row()
                    now, states = key, form.beginnings()
                for text in texts or ():
                    states = [form.after(s, text) for s in states]
        if now is not None:
            yield row()

    return read


def _beginnings(effects: DataFrame) -> DataFrame:
    """True state at the beginning of every range: one row per range, combined in the order of the file.

    A range keeps, turns or fixes the quote state, so the state is that of the last range that fixed it, turned as often as a range since then
    turned it; the depth is the sum over the earlier ranges, each from its true beginning.
    """
    before = "over (partition by file order by begins rows between unbounded preceding and 1 preceding)"
    turned = effects.withColumn("turns", F.expr("case when from_out = 1 and from_in = 0 then 1 else 0 end"))
    turned = turned.withColumn("all_turns", F.expr("sum(turns) over (partition by file order by begins)"))
    fixed = turned.withColumn("fixed", F.expr("case when from_out = from_in then struct(from_out as state, all_turns as at) end"))
    known = fixed.withColumn("last_fixed", F.expr(f"last(fixed, true) {before}")).withColumn("turns_before", F.col("all_turns") - F.col("turns"))
    state = F.coalesce(F.col("last_fixed.state"), F.lit(0)) + F.col("turns_before") - F.coalesce(F.col("last_fixed.at"), F.lit(0))
    placed = known.withColumn("inside", (state % 2).cast("int")).withColumn("moves", F.expr("case when inside = 1 then depth_in else depth_out end"))
    depth = F.coalesce(F.expr(f"sum(moves) {before}"), F.lit(0)).cast("int")
    is_last = F.expr("begins = max(begins) over (partition by file)")
    return placed.select("file", "begins", "inside", depth.alias("depth"), is_last.alias("is_last"))


class _Range:
    """One range being cut: ``head`` is the fragment up to its first border, ``tail`` that from its last one."""

    def __init__(self, form: Delimited | JsonArray, key: tuple[str, int], inside: int, depth: int, is_last: bool):
        self._form, self.key, self._state, self._is_last = form, key, (inside, depth), is_last
        self._begun = key[1] == 0 or form.is_border(self._state)
        self._held: list[str] = []
        self._place = 0

    def add(self, texts: list[str] | None) -> Iterator[pa.RecordBatch]:
        if texts is None:
            yield from self._rows([("DATA_ENCODING", None, None)])
            return
        if self.key[1] == 0 and self._place == 0 and not self._held and texts[0].startswith("\ufeff"):
            texts[0] = texts[0][1:]
        groups = []
        for text in texts:
            self._held.append(text)
            self._state = self._form.after(self._state, text)
            if self._form.is_border(self._state):
                if self._begun:
                    groups.append(self._held)
                else:
                    yield from self._rows([("head", self._form.joint.join(self._held) + self._form.closing, None)])
                self._held, self._begun = [], True
        if groups:
            yield from self._rows(self._form.records(groups))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self._begun and self._is_last:
            yield from self._rows(self._form.end(self._held) if self._held or self._form.closing else [])
        elif self._held:
            yield from self._rows([("tail" if self._begun else "head", self._form.joint.join(self._held), None)])

    def _rows(self, items) -> Iterator[pa.RecordBatch]:
        out = [(*self.key, self._place + n, *item) for n, item in enumerate(items)]
        self._place += len(out)
        if out:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "begins", "place", "kind", "text", "cells"])


def _cut(form: Delimited | JsonArray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole records of every range, in order, and the fragments at its ends."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for key, at, texts in _runs(batch):
                if now is None or key != now.key:
                    if now is not None:
                        yield from now.end()
                    now = _Range(form, key, *(batch.column(c)[at].as_py() for c in ("inside", "depth", "is_last")))
                yield from now.add(texts)
        if now is not None:
            yield from now.end()

    return read


def _across(form: Delimited | JsonArray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records that lie across borders, from their fragments."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                file, begins, place = (batch.column(c)[n].as_py() for c in ("file", "begins", "place"))
                one = _Range(form, (file, begins), 0, 0, False)
                one._place = place
                yield from one._rows(form.joined(batch.column("parts")[n].as_py()))

    return read


def split_records(spark: SparkSession, path: str, form: Delimited | JsonArray, store: Callable[[DataFrame], DataFrame] = freeze) -> DataFrame:
    """Rows ``file``, ``in_file``, ``kind``, ``text``, ``cells``: every record with its 0-based place in its file, and refused places with a code as ``kind``.

    The file is read twice, each range by its own task: once for what it does to the state, once to be cut; the cut records are stored.
    One row per range is combined globally; of the text, only what lies across a border is shuffled.
    """
    ranges = _ranges(spark, path, form.separator)
    effects = ranges.mapInArrow(_effects(form), "file string, begins long, from_out long, depth_out long, from_in long, depth_in long")
    # One row per range, so bounded by the number of splits that Spark plans.
    begun = ranges.join(F.broadcast(_beginnings(store(effects))), ["file", "begins"])
    pieces = store(begun.select("file", "begins", "value", "inside", "depth", "is_last").mapInArrow(_cut(form), PIECE))
    fragments = pieces.where("kind in ('head', 'tail')").select("file", "begins", "place", "kind", "text")
    # At most two fragments a range: a tail and the heads that follow it are one record, which belongs to the tail's place.
    order = "over (partition by file order by begins, place)"
    of = fragments.withColumn("owner", F.expr(f"last(case when kind = 'tail' then struct(begins, place) end, true) {order}"))
    whole = of.groupBy("file", "owner.begins", "owner.place").agg(F.array_sort(F.collect_list(F.struct(F.col("begins").alias("at"), F.col("text")))).alias("parts"))
    whole = whole.select("file", F.coalesce("begins", F.lit(0)).alias("begins"), F.coalesce("place", F.lit(0)).alias("place"), F.col("parts.text").alias("parts"))
    records = pieces.where("kind not in ('head', 'tail')").unionByName(whole.mapInArrow(_across(form), PIECE))
    # Every range counts the records that begin in it; a head fragment takes no place of its own.
    counted = pieces.withColumn("is_head", (F.col("kind") == "head").cast("long"))
    per_range = counted.groupBy("file", "begins").agg(F.count(F.lit(1)).alias("n"), F.sum("is_head").alias("heads"))
    offsets = per_range.select("file", "begins", "heads", F.expr("sum(n - heads) over (partition by file order by begins) - (n - heads)").alias("before"))
    placed = records.join(F.broadcast(offsets), ["file", "begins"])
    return placed.select("file", (F.col("before") + F.col("place") - F.col("heads")).alias("in_file"), "kind", "text", "cells")
