"""Tokens of evidence attributed to its fields or sections, from one encoding of the whole text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.vocabulary import vocabulary

#: What happens to a token that reaches over the border of two sections.
RULES = ("first", "largest")


def field_sections(evidence: DataFrame, fields: Sequence[str] = ("description", "extraction", "interpretation", "limitations")) -> DataFrame:
    """Rows ``evidence_id``, ``text`` (the fields joined by line ends) and ``sections`` (``section``, ``start``, ``end``).

    A null field is an empty section at its place. Offsets are code points; the line ends belong to no section.
    """
    texts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    out, at = [], F.lit(0)
    for name, text in zip(fields, texts, strict=True):
        out.append(F.struct(F.lit(name).alias("section"), at.alias("start"), (at + F.char_length(text)).alias("end")))
        at = at + F.char_length(text) + F.lit(1)
    return evidence.select("evidence_id", F.concat_ws("\n", *texts).alias("text"), F.array(*out).alias("sections"))


def line_sections(text: Column) -> Column:
    """The lines of a text as sections named by their number from 1; a line's end belongs to the line. Linear in the text."""

    @F.pandas_udf("array<struct<section:string,start:int,end:int>>")
    def sections(texts: pd.Series) -> pd.Series:
        return texts.map(_lines_of)

    return sections(F.coalesce(text, F.lit("")))


def _lines_of(text: str) -> list[dict]:
    sizes = np.fromiter((len(line) + 1 for line in text.split("\n")), np.int64)
    sizes[-1] -= 1
    ends = np.cumsum(sizes).tolist()
    return [{"section": str(n), "start": start, "end": end} for n, (start, end) in enumerate(zip([0, *ends], ends, strict=False), 1)]


def token_offsets(text: str, ids: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point span of each token. A token that holds part of a code point covers that code point."""
    ends = np.cumsum(token_bytes[ids])
    starts = ends - token_bytes[ids]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) == len(text):
        return starts, ends
    leading = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points begun before each byte
    begun = leading[np.minimum(starts + 1, len(raw))] - 1  # the one that holds the first byte
    return begun, leading[ends]


def allocate(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sorted, disjoint sections: section of each token (-1: none), and whether
    the token reaches out of it into another section or a gap.

    ``first``: the section of the token's first code point. ``largest``: the section with most of its code points, the
    earlier one of equals. Under either rule a token none of whose code points lies in a section has none; under ``first``
    a token that begins in a gap goes to the first section that it reaches.
    """
    filled = np.nonzero(high > low)[0]
    out, crosses = np.full(len(starts), -1), np.zeros(len(starts), bool)
    if not len(filled) or not len(starts):
        return out, crosses
    low, high = low[filled], high[filled]
    left = np.searchsorted(high, starts, "right")  # first section that ends after the token begins
    right = np.searchsorted(low, ends, "left") - 1  # last section that begins before the token ends
    touched = left <= right
    out[touched] = filled[left[touched]]
    crosses[touched] = (starts[touched] < low[left[touched]]) | (ends[touched] > high[left[touched]])
    if rule == "largest":
        for n in np.nonzero(touched & (left < right))[0]:
            parts = np.arange(left[n], right[n] + 1)
            share = np.minimum(ends[n], high[parts]) - np.maximum(starts[n], low[parts])
            out[n] = filled[parts[np.argmax(share)]]
    return out, crosses


def attribute_tokens(sectioned: DataFrame, vocabulary_path: str, *, rule: str = "first") -> DataFrame:
    """Rows ``evidence_id``, ``section``, ``start``, ``end``, ``n_tokens``, ``n_crossing``, one per section, and one
    with section null for the tokens of no section, so that the rows of an evidence text add up to its encoding.

    ``sectioned`` has ``evidence_id``, ``text`` and ``sections`` as ``field_sections`` makes them: (``section``, ``start``, ``end``) in code points;
    they may leave gaps and may be empty but not overlap. The whole text is encoded once; the spans of its tokens are joined to
    the sections as intervals, and a token that reaches over a border is allocated by ``rule`` (see ``allocate``) and counted in
    ``n_crossing`` there. No shuffle; one text is in memory at a time.

    Defined cases: a null text is empty, null sections are none; an empty text has 0 tokens in each section; repeated rows give
    repeated results; an empty table gives an empty table. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    id_type = sectioned.schema["evidence_id"].dataType.simpleString()
    schema = f"evidence_id {id_type}, section string, start int, end int, n_tokens long, n_crossing long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            rows, ids_of = [[] for _ in range(5)], []
            for n in range(batch.num_rows):
                text = batch.column(1)[n].as_py() or ""
                ids = vocab.encode(text)
                starts, ends = token_offsets(text, ids, vocab.token_bytes)
                sections = sorted(batch.column(2)[n].as_py() or [], key=lambda s: (s["start"], s["end"]))
                low, high = (np.array([s[k] for s in sections], np.int64) for k in ("start", "end"))
                where, crosses = allocate(starts, ends, low, high, rule)
                per = np.bincount(where + 1, minlength=len(sections) + 1)
                over = np.bincount(where[crosses] + 1, minlength=len(sections) + 1)
                for k, section in enumerate([{"section": None, "start": None, "end": None}, *sections]):
                    ids_of.append(batch.column(0)[n])
                    for column, value in zip(rows, (section["section"], section["start"], section["end"], int(per[k]), int(over[k])), strict=True):
                        column.append(value)
            if ids_of:
                types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py() for i in ids_of], batch.column(0).type), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))],
                    names=["evidence_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    return sectioned.select("evidence_id", "text", "sections").mapInArrow(count, schema)
