"""Secrets in verbatim entries: declared patterns, and windows of high entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: The kinds of the declared patterns in their order, with the least length of what is tested.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the length can be part of the pattern
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
BASE_KINDS = ("assign", "access", "hex")

#: Character classes of the entropy scan: kind, pattern of a candidate string, window, least bits per
#: character over a window, and the groups of characters of which a window must hold so many.
CLASSES = (
    ("entropy_hex", re.compile(r"(?<![A-Za-z0-9])(?:[0-9A-F]{20,}|[0-9a-f]{20,23})(?![A-Za-z0-9])"), 20, 3.0, 2),
    ("entropy_alnum", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9]{20,}(?![A-Za-z0-9+/_=-])"), 20, 3.75, 3),
    ("entropy_base64", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9]*[+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])"), 24, 4.0, 3),
    # One case and digits, also as a segment of a longer name; hexadecimal strings have kinds of their own.
    ("entropy_lower", re.compile(r"(?<![A-Za-z0-9+])(?![0-9a-f]+(?![A-Za-z0-9]))[a-z0-9]{20,}(?![A-Za-z0-9+])"), 20, 3.5, 2),
    ("entropy_upper", re.compile(r"(?<![A-Za-z0-9+])(?![0-9A-F]+(?![A-Za-z0-9]))[A-Z0-9]{20,}(?![A-Za-z0-9+])"), 20, 3.5, 2),
)
ORDER = {kind: n for n, kind in enumerate((*BASE_KINDS, *(c[0] for c in CLASSES)))}

#: Candidate strings that are known to be no secrets.
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # identifiers
    re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[A-Z][a-z]+)*\d{0,4}"),  # names in camel case
)
#: Slugs and paths, known as well unless a segment of so many letters and digits has so much of its greatest entropy.
SLUG = re.compile(r"(?:[a-z0-9]+[-_/])+[a-z0-9]+")
SEGMENT, SEGMENT_SHARE = 12, 0.81
#: Windows that hold a sample, or of which half goes on in order, are samples and alphabets.
SAMPLE = re.compile(r"EXAMPLE|example|abcdefghij|ABCDEFGHIJ|0123456789")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the declared patterns: leftmost, not overlapping within a kind; too short ones are dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def entropy_windows(candidate: str, window: int) -> Iterator[tuple[int, float]]:
    """(start, bits per character) of every window, by counts that change by one character in and one out.

    With n log2 n summed over the counts of a window of w characters, its entropy is log2 w less that sum over w.
    """
    weight = [0.0, *(n * math.log2(n) for n in range(1, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for at, char in enumerate(candidate):
        n = counts.get(char, 0)
        total += weight[n + 1] - weight[n]
        counts[char] = n + 1
        if at >= window:
            gone = candidate[at - window]
            n = counts[gone]
            total += weight[n - 1] - weight[n]
            counts[gone] = n - 1
        if at >= window - 1:
            yield at - window + 1, math.log2(window) - total / window


def _groups(part: str) -> int:
    return sum((any("a" <= c <= "z" for c in part), any("A" <= c <= "Z" for c in part), any(c.isdigit() for c in part), any(c in "+/_=-" for c in part)))


def _is_slug(candidate: str) -> bool:
    """Whether the candidate is a slug or path of segments that are words or numbers."""
    if not SLUG.fullmatch(candidate):
        return False
    for part in re.split("[-_/]", candidate):
        size = min(len(part), 20)
        if size >= SEGMENT and _groups(part) > 1 and any(bits >= SEGMENT_SHARE * math.log2(size) for _, bits in entropy_windows(part, size)):
            return False
    return True


def _is_sample(part: str) -> bool:
    return SAMPLE.search(part) is not None or 2 * sum(ord(y) - ord(x) == 1 for x, y in zip(part, part[1:])) >= len(part)


def entropy_spans(text: str, allow_sha256: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Unions of overlapping windows at or above their class's entropy, outside allowed candidate strings."""
    found = []
    for kind, pattern, window, least, groups in CLASSES:
        for m in pattern.finditer(text):
            candidate = m.group()
            if any(p.fullmatch(candidate) for p in ALLOWED) or _is_slug(candidate) or hashlib.sha256(candidate.encode()).hexdigest() in allow_sha256:
                continue
            begin = end = None
            for at, bits in entropy_windows(candidate, window):
                part = candidate[at : at + window]
                if bits < least or _groups(part) < groups or _is_sample(part):
                    continue
                if end is not None and at <= end:
                    end = at + window
                    continue
                if end is not None:
                    found.append((m.start() + begin, m.start() + end, kind))
                begin, end = at, at + window
            if end is not None:
                found.append((m.start() + begin, m.start() + end, kind))
    # A run of letters and digits within a span of the widest class is not repeated.
    wide = [s for s in found if s[2] == "entropy_base64"]
    starts = [s[0] for s in wide]
    return [s for s in found if s[2] == "entropy_base64" or not (n := bisect_right(starts, s[0])) or wide[n - 1][1] < s[1]]


def scan_text(text: str | None, allow_sha256: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """All spans of a whole text, by start, then kind. An entropy span inside a declared one is not repeated."""
    text = text or ""
    base = base_spans(text)
    starts = [b[0] for b in sorted(base)]
    reach = list(accumulate((b[1] for b in sorted(base)), max))  # how far the declared spans up to each one go
    more = [s for s in entropy_spans(text, allow_sha256) if not (n := bisect_right(starts, s[0])) or reach[n - 1] < s[1]]
    return sorted(base + more, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def secret_spans(entries: DataFrame, *, allow_sha256: tuple[str, ...] = ()) -> DataFrame:
    """Per entry: ``entry_id`` and ``spans``, an array of (``kind``, ``start``, ``end``) over the whole ``exact_text``.

    Kinds ``assign``, ``access`` and ``hex`` are the declared patterns; they are never suppressed. The method adds windows
    of high Shannon entropy within candidate strings, one kind per character class, with window and threshold of the
    class. Candidates are suppressed when an allowed shape covers them or their SHA-256 is in ``allow_sha256``.
    Offsets are code points, ends exclusive. No secret itself is returned.

    One pass over each text, one task per input split, no shuffle. Defined cases: null and empty texts have no
    spans; repeated rows give equal rows; a null id stays null; an empty table gives an empty table. Other columns
    are not read.
    """
    id_type, allowed = entries.schema["entry_id"].dataType.simpleString(), frozenset(allow_sha256)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in scan_text(t.as_py(), allowed)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span_type)], names=["entry_id", "spans"])

    return entries.select("entry_id", "exact_text").mapInArrow(scan, f"entry_id {id_type}, spans array<struct<kind:string,start:int,end:int>>")
