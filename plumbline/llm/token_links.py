"""Two tokenizers aligned over verbatim entries; corpus-wide link counts from inverted bitmaps of id pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.vocabulary import PieceVocabulary, Vocabulary, piece_vocabulary, vocabulary
from plumbline.session import Scratch

#: A block of entries numbered together: at most so many entries (a bitmap has one bit for each), and closed at so many postings.
ENTRIES, POSTINGS = 1 << 16, 2_000_000
#: A plane of so many entries is a bitmap of ``ENTRIES`` bits; a sparser one lists the numbers of its entries in 2 bytes each.
DENSE, DENSE_BYTES = ENTRIES // 16, ENTRIES // 8
#: Salts under which the blocks of one pair meet its score.
SALTS = 8


class Aligner:
    """Aligns the tokens of one text by the byte offsets at which tokens of both vocabularies end."""

    def __init__(self, byte_vocabulary: Vocabulary, piece_vocabulary: PieceVocabulary):
        self._a, self._b = byte_vocabulary, piece_vocabulary
        # Decimal ids with the sign that follows: within a side, after the A side or the B side of a group, at the end.
        self._text = [f"{n}{sign}" for sign, size in ((",", max(len(self._a.tokens), len(self._b.tokens))), ("|", len(self._a.tokens)), (";", len(self._b.tokens))) for n in range(size)]
        self._bar = max(len(self._a.tokens), len(self._b.tokens))
        self._semicolon = self._bar + len(self._a.tokens)

    def align(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of both sides and the places of the last token of each group on both sides; None for a text that has no tokens."""
        if not text:
            return None
        raw = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self._a.encode_plain(" " + text), self._b.encode(text)
        if b"".join(map(self._b.tokens.__getitem__, b.tolist())) != raw or b"".join(map(self._a.tokens.__getitem__, a.tolist())) != raw:
            return None
        a_ends, b_ends = np.cumsum(self._a.token_bytes[a]), np.cumsum(self._b.token_bytes[b])
        at = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        a_last = np.flatnonzero(b_ends[at] == a_ends)
        return a, b, a_last, at[a_last]

    def groups_text(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3`` in order."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        a[a_last] += self._bar
        b[b_last] += self._semicolon
        # Each token's group, then the A side before the B side.
        of_a = np.searchsorted(a_last, np.arange(len(a)))
        of_b = np.searchsorted(b_last, np.arange(len(b)))
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        return "".join(map(self._text.__getitem__, np.concatenate([a, b])[order].tolist()))[:-1]


def planes_of(pairs: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Distinct pairs, and for each its planes: plane k holds the entries (numbers below ``ENTRIES``) whose count has bit k set.

    A plane is the sorted 2-byte numbers of its entries or, from ``DENSE`` entries on, their bitmap; an empty plane has no bytes.
    """
    order = np.lexsort((numbers, pairs))
    pairs, numbers, counts = pairs[order], numbers[order].astype("<u2"), counts[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    row = np.repeat(np.arange(len(first)), np.diff(first, append=len(pairs)))
    depth = np.frexp(np.maximum.reduceat(counts, first).astype(float))[1] if len(first) else np.zeros(0, int)
    begins = np.concatenate([[0], np.cumsum(depth)]).astype(np.int64)  # of each pair's planes
    where, entry = [], []
    for bit in range(int(depth.max(initial=0))):
        at = np.flatnonzero(counts >> bit & 1)
        where.append(begins[row[at]] + bit)
        entry.append(numbers[at])
    where, entry = np.concatenate([*where, np.zeros(0, np.int64)]), np.concatenate([*entry, np.zeros(0, "<u2")])
    order = np.argsort(where, kind="stable")
    where, entry = where[order], entry[order]
    size = np.bincount(where, minlength=begins[-1])
    stop = np.cumsum(size)
    pieces, done = [], 0
    for plane in np.flatnonzero(size >= DENSE).tolist():
        low, high = int(stop[plane] - size[plane]), int(stop[plane])
        bits = np.zeros(ENTRIES, bool)
        bits[entry[low:high]] = True
        pieces += [entry[done:low].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        done = high
    pieces.append(entry[done:].tobytes())
    ends = np.concatenate([[0], np.cumsum(np.where(size >= DENSE, DENSE_BYTES, 2 * size))]).astype(np.int32)
    planes = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(pieces))])
    return pairs[first], pa.ListArray.from_arrays(pa.array(begins, pa.int32()), planes)


def opened(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bit and entry number of every entry in every plane."""
    flat = planes.flatten()
    depth = np.array(planes.value_lengths())
    row = np.repeat(np.arange(len(depth)), depth)
    bit = np.arange(len(row)) - np.repeat(np.cumsum(depth) - depth, depth)
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    size, entry, done = np.diff(ends) // 2, [], int(ends[0]) if len(ends) else 0
    for plane in np.flatnonzero(np.diff(ends) == DENSE_BYTES).tolist():
        low, high = int(ends[plane]), int(ends[plane + 1])
        found = np.flatnonzero(np.unpackbits(np.frombuffer(data[low:high], np.uint8), bitorder="little"))
        entry += [np.frombuffer(data[done:low], "<u2"), found.astype("<u2")]
        size[plane], done = len(found), high
    entry.append(np.frombuffer(data[done : int(ends[-1]) if len(ends) else 0], "<u2"))
    return np.repeat(row, size), np.repeat(bit, size), np.concatenate(entry)


class _Block:
    """Entries of one task numbered from 0, and the postings of their links."""

    def __init__(self):
        self.entries, self.postings, self._pairs, self._counts, self._numbers = 0, 0, [], [], []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs, counts = np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_counts=True)
        self._pairs.append(pairs)
        self._counts.append(counts)
        self._numbers.append(np.full(len(pairs), self.entries, np.uint16))
        self.postings += len(pairs)

    def rows(self) -> tuple[np.ndarray, pa.ListArray]:
        return planes_of(np.concatenate(self._pairs), np.concatenate(self._numbers), np.concatenate(self._counts))


def inverted_pairs(entries: DataFrame, byte_vocabulary_path: str, piece_vocabulary_path: str) -> DataFrame:
    """Entry rows (``block``, ``number``, ``entry_id``, ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256``) and pair rows (``block``, ``a``, ``b``,
    ``planes``) in one table, from one encoding of each text; ``number`` is null in pair rows.

    A block holds entries of one task: at most 65,536, and it is closed at 2,000,000 postings, so a task holds no more whatever its partition holds.
    The rows must be stored before use, because a task run again may number its entries in another order.
    """
    id_type = entries.schema["entry_id"].dataType.simpleString()
    schema = f"block long, number int, entry_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, a int, b int, planes array<binary>"

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary(byte_vocabulary_path), piece_vocabulary(piece_vocabulary_path))
        name, block, fields = TaskContext.get().partitionId() << 32, _Block(), None

        def closed() -> Iterator[pa.RecordBatch]:
            if block.postings:
                pairs, planes = block.rows()
                for at in range(0, len(pairs), 65_536):
                    part, some = pairs[at : at + 65_536], planes.slice(at, 65_536)
                    yield _table(fields, len(part), block=np.full(len(part), name), a=(part >> 32).astype(np.int32), b=(part & 0xFFFFFFFF).astype(np.int32), planes=some)

        for batch in batches:
            fields = fields or _fields(batch.schema.field(0).type)
            seen, rows = [], []
            for n, text in enumerate(batch.column(1)):
                found = aligner.align(text.as_py())
                if found is None:
                    rows.append((name, block.entries, 0, 0, 0, ""))
                else:
                    a, b, a_last, b_last = found
                    block.add(a[a_last], b[b_last])
                    digest = hashlib.sha256(aligner.groups_text(*found).encode()).hexdigest()
                    rows.append((name, block.entries, len(a), len(b), len(a_last), digest))
                seen.append(n)
                block.entries += 1
                if block.entries == ENTRIES or block.postings >= POSTINGS:
                    yield from closed()
                    name, block = name + 1, _Block()
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6
            names = ("block", "number", "n_a", "n_b", "n_groups", "groups_sha256")
            yield _table(fields, len(rows), entry_id=batch.column(0), **dict(zip(names, columns, strict=True)))
        yield from closed()

    return entries.select("entry_id", "exact_text").mapInArrow(invert, schema)


def _fields(id_type: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    return pa.schema([("block", long), ("number", pa.int32()), ("entry_id", id_type), ("n_a", long), ("n_b", long), ("n_groups", long),
                      ("groups_sha256", text), ("a", pa.int32()), ("b", pa.int32()), ("planes", pa.list_(pa.binary()))])


def _table(fields: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    made = [pa.nulls(rows, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in fields]
    return pa.RecordBatch.from_arrays([m.cast(f.type) for m, f in zip(made, fields, strict=True)], schema=fields)


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the OR of each row's planes, and links: the entries of plane k count 2 ** k times."""
    for batch in batches:
        row, bit, entry = opened(batch.column(2))
        any_plane = np.unique(row << 16 | entry)
        documents = np.bincount(any_plane >> 16, minlength=batch.num_rows)
        links = np.zeros(batch.num_rows, np.int64)
        np.add.at(links, row, np.int64(1) << bit)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(documents, pa.int64()), pa.array(links)], names=["a", "b", "n_entries", "n_links"])


def pair_scores(inverted: DataFrame) -> DataFrame:
    """Per id pair: ``a``, ``b``, ``n_entries``, ``n_links``, and ``best`` (whether no other A id is linked with this B id more often).

    No entry lies in two blocks, so the OR of a pair's bitmaps over all blocks has as many bits as theirs together: counts are partial sums.
    """
    counted = inverted.where("number is null").select("a", "b", "planes").mapInArrow(_popcounts, "a int, b int, n_entries long, n_links long")
    pairs = counted.groupBy("a", "b").agg(F.sum("n_entries").alias("n_entries"), F.sum("n_links").alias("n_links"))
    highest = pairs.groupBy("b").agg(F.max("n_links").alias("highest"))
    return pairs.join(highest, "b").select("a", "b", "n_entries", "n_links", (F.col("n_links") == F.col("highest")).alias("best"))


def _returned(entries: pa.Table, postings: pa.Table) -> pa.Table:
    """The entries of one block with the scores that its postings return."""
    best, total = np.zeros(ENTRIES, np.int64), np.zeros(ENTRIES, np.int64)
    for part in postings.to_batches():
        row, bit, entry = opened(part.column("planes"))
        times = np.int64(1) << bit
        np.add.at(total, entry, times * np.array(part.column("n_links"))[row])
        np.add.at(best, entry, times * np.array(part.column("best")).astype(np.int64)[row])
    number = np.array(entries.column("number"))
    kept = entries.select(["entry_id", "n_a", "n_b", "n_groups"])
    kept = kept.append_column("n_links", entries.column("n_groups")).append_column("n_best", pa.array(best[number])).append_column("count_sum", pa.array(total[number]))
    return kept.append_column("groups_sha256", entries.column("groups_sha256"))


def token_links(entries: DataFrame, byte_vocabulary_path: str, piece_vocabulary_path: str, *, salts: int = SALTS, scratch: Scratch | None = None) -> DataFrame:
    """Per entry: ``entry_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``entries`` are verbatim entries with ``entry_id`` (any type) and ``exact_text``. Side A encodes a space and the text with a byte-level vocabulary, side B
    the text with a piece model, which adds the space itself; special tokens are plain text on both sides. Byte offsets at which tokens of both
    sides end cut them into groups; the two tokens that end there are linked. The count of an id pair is the number of its links in all entries.
    ``n_best`` counts an entry's links whose pair has the highest count of its B id (ties included), ``count_sum`` adds the counts over its links;
    ``groups_sha256`` is the digest of the groups as ``a1,a2|b1;a3|b2,b3``.

    Every pair has an inverted list of bitmaps, one set of planes per block of entries: plane k has the entries that hold the pair a number of times with
    bit k set. Popcounts of the planes give link counts, of their OR the number of entries (``pair_scores``). The postings then meet their pair's score,
    the blocks of a frequent pair under ``salts``, and carry it back to the entries of their block, block by block. Nothing grows with the number of entries
    in one task: a block has at most 65,536 entries and little more than 2,000,000 postings.

    Defined cases: a null or empty text, and one whose A or B bytes differ from a space and the text, has no tokens: zeros and an empty
    ``groups_sha256``; repeated rows count each; a null id stays null; an empty table gives an empty table. Other columns are not read.
    ``scratch`` owns the stored tables; without one they stay in the shared folder.
    """
    store = scratch or Scratch(entries.sparkSession)
    inverted = store.freeze(inverted_pairs(entries, byte_vocabulary_path, piece_vocabulary_path))
    salted = pair_scores(inverted).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    postings = inverted.where("number is null").select("block", "a", "b", "planes").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    scored = postings.join(salted.hint("merge"), ["a", "b", "salt"]).select(F.col("block").alias("home"), "n_links", "best", "planes")
    rows = inverted.where("number is not null").select("block", "number", "entry_id", "n_a", "n_b", "n_groups", "groups_sha256")
    id_type = entries.schema["entry_id"].dataType.simpleString()
    schema = f"entry_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(scored.groupBy("home")).applyInArrow(_returned, schema)
