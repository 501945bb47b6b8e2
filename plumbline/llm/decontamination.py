"""Trial items found again in verbatim entries: walk embedding, sampled-position hashing, exact edit check."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed seed of the random walks and of the sampled positions.
SEED = 20240611
#: Independent walks; each serves several samples.
WALKS = 2
#: Sampled positions that make one key, and the steps between neighbours: about two steps copy one word.
SAMPLED, APART = 4, 3
#: Most samples per walk that the plan may choose; a class that needs more is looked up by exact pieces.
MOST_SAMPLES = 32
#: Most words of an exact piece that make its key.
PIECE_WORDS = 8
#: Window starts embedded at a time.
BLOCK = 1 << 12
#: Words of short texts that are embedded together.
TOGETHER = 1 << 16
#: Bits of the table that is asked before the keys are searched.
TABLE_BITS = 22

#: Letters of scripts that are written without spaces (Thai to Lao, Burmese, Khmer, kana, Han): each is a word.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?![\W_])[{_ALONE}]|[^\W_{_ALONE}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - TABLE_BITS)


def item_words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits: the symbols that are edited. Without spaces, each letter is one."""
    return _WORD.findall((text or "").lower())


class SymbolCache(dict):
    """Word -> 64-bit symbol."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def symbols_of(words: list[str], cache: SymbolCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> int:
    """Smallest number of word edits between ``item`` and any part of ``text``, exact."""
    m = len(item)
    row = np.arange(m + 1)
    best, steps = m, np.arange(m + 1)
    for symbol in text:
        new = np.empty(m + 1, np.int64)
        new[0] = 0
        np.minimum(row[1:] + 1, row[:-1] + (item != symbol), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(row[m]))
    return best


def walk_bits(walk: int, steps: int) -> np.ndarray:
    """One bit per (step, low six bits of the symbol): whether the walk moves on after copying it."""
    return np.random.default_rng([SEED, walk]).integers(0, 2, (steps, 64), dtype=np.int32)


def embedded(symbols: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The walk embedding of the windows at ``starts``, one row per step: each step copies the current symbol, and
    a random bit of (step, symbol) says whether to move to the next. Beyond the end the symbol is 0."""
    steps = len(bits)
    padded = np.concatenate([symbols, np.zeros(steps + 1, np.uint64)])
    low = (padded & np.uint64(63)).astype(np.int32)
    at, out = starts.astype(np.int32), np.empty((steps, len(starts)), np.uint64)
    for step in range(steps):
        padded.take(at, out=out[step], mode="clip")
        at += bits[step].take(low.take(at, mode="clip"), mode="clip")
    return out


def gram_keys(symbols: np.ndarray, size: int) -> np.ndarray:
    """The key of every run of ``size`` symbols."""
    count = max(0, len(symbols) - size + 1)
    key = symbols[:count] + np.uint64(size)
    for n in range(1, size):
        key *= _MIX
        key ^= symbols[n : n + count]
    return key * _MIX


def exact_pieces(size: int, edits: int) -> Iterator[tuple[int, int]]:
    """(start, words) of ``edits + 1`` pieces that cover ``size`` words: edits leave at least one of them as it is."""
    pieces = min(size, edits + 1)
    for n in range(pieces):
        start, end = size * n // pieces, size * (n + 1) // pieces
        yield start, min(PIECE_WORDS, end - start)


@dataclass
class _Class:
    """Items of like length: windows start every ``stride`` words of a text and are walked ``len(bits[w])`` steps."""

    stride: int
    bits: list[np.ndarray]
    positions: list[np.ndarray]  # per walk: (samples, SAMPLED)
    salt: int

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per sample the key of each window, and the last symbol in it: 0 if the window ran past the end."""
        for walk, bits in enumerate(self.bits):
            walked = embedded(symbols, starts, bits)
            for s, where in enumerate(self.positions[walk]):
                key = walked[where[0]] + np.uint64(((self.salt * WALKS + walk) * MOST_SAMPLES + s + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
                for p in where[1:]:
                    key *= _MIX
                    key ^= walked[p]
                yield key * _MIX, walked[where[-1]]


class ItemIndex:
    """Keys of all trial items. Its size depends on the items alone; the caller bounds their number.

    Windows of a text start every ``stride`` words (an eighth of the shortest item, at most 8) and are as long as the
    shortest item of their class. An item is entered at each of its starts, so every window that begins within an
    occurrence, whatever the edits before it, meets an entry that begins at the same word.

    Items too short for an edit, and classes for which no number of samples reaches the recall, are looked up by exact
    pieces instead: one more piece than edits, so that none is missed. ``planned_recall`` is the lowest of all classes.
    """

    def __init__(self, items: list[tuple[object, list[str]]], max_edits: float, recall: float):
        cache = SymbolCache()
        self.items = [(item_id, symbols_of(words, cache)) for item_id, words in items if words]
        self.limit = [int(len(s) * max_edits) for _, s in self.items]
        groups = defaultdict(list)
        exact = [n for n, limit in enumerate(self.limit) if not limit]
        self.planned_recall = 1.0
        for n, (_, symbols) in enumerate(self.items):
            size = len(symbols)
            if not self.limit[n]:
                continue
            groups[8 if size >= 40 else 4 if size >= 12 else 1].append(n)
        self.classes: list[_Class] = []
        keys, places = [], []
        with np.errstate(over="ignore"):
            for stride, members in sorted(groups.items()):
                kind, reached = self._planned(stride, members, max_edits, recall)
                if reached < recall:
                    exact += members
                    continue
                self.planned_recall = min(self.planned_recall, reached)
                self.classes.append(kind)
                for n in members:
                    self._enter(kind, n, keys, places)
            self.pieces = self._pieces(exact)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.places = np.concatenate(places) if places else np.zeros((0, 2), np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.places = self.keys[order], self.places[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.keys >> _TOP).astype(np.intp)] = True

    def _enter(self, kind: _Class, n: int, keys: list, places: list) -> None:
        symbols = self.items[n][1]
        starts = np.arange(len(symbols))
        for key, last in kind.keys(symbols, starts):
            # A window that runs past the item would hold what follows the item; a short item is entered as it is.
            inside = (last != 0) | (starts == 0)
            keys.append(key[inside])
            places.append(np.stack([np.full(int(inside.sum()), n), starts[inside]], axis=1))

    def _pieces(self, members: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Per size of piece: the sorted keys and their (item, start)."""
        entered = defaultdict(list)
        for n in members:
            symbols = self.items[n][1]
            for start, words in exact_pieces(len(symbols), self.limit[n]):
                entered[words].append((int(gram_keys(symbols[start : start + words], words)[0]), n, start))
        out = []
        for words, rows in sorted(entered.items()):
            rows.sort()
            out.append((words, np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64)))
        return out

    def _planned(self, stride: int, members: list[int], max_edits: float, recall: float) -> tuple[_Class, float]:
        """The fewest samples per walk that find ``recall`` of copies of the items with all allowed edits, and what they find."""
        shortest = min(len(self.items[n][1]) for n in members)
        steps = max(SAMPLED, 2 * shortest - 2 * stride)
        rng = np.random.default_rng([SEED, stride])
        apart = min(APART, max(1, (steps - 1) // (SAMPLED - 1)))
        span = 1 + apart * (SAMPLED - 1)
        first = rng.integers(0, max(1, steps - span + 1), (WALKS, MOST_SAMPLES))
        where = np.minimum(first[:, :, None] + apart * np.arange(SAMPLED), steps - 1)
        kind = _Class(stride, [walk_bits(w, steps) for w in range(WALKS)], [where[w] for w in range(WALKS)], len(self.classes))
        hits = np.zeros((0, MOST_SAMPLES), bool)
        for n in [members[i] for i in rng.integers(0, len(members), 200)]:
            symbols = self.items[n][1]
            copy = self._edited(symbols, self.limit[n], rng)
            before = int(rng.integers(0, stride))
            text = np.concatenate([rng.integers(1, 1 << 62, before + stride).astype(np.uint64), copy, rng.integers(1, 1 << 62, steps).astype(np.uint64)])
            mine = kind.keys(symbols, np.arange(len(symbols)))
            theirs = kind.keys(text, np.arange(0, len(text) - steps, stride))
            hit = np.array([bool(np.isin(x[end != 0], y).any()) for (x, end), (y, _) in zip(mine, theirs, strict=True)]).reshape(WALKS, MOST_SAMPLES)
            hits = np.vstack([hits, hit.any(axis=0)[None]])
        reached = np.logical_or.accumulate(hits, axis=1).mean(axis=0)
        samples = int(np.argmax(reached >= recall)) + 1 if (reached >= recall).any() else MOST_SAMPLES
        kind.positions = [p[:samples] for p in kind.positions]
        last = int(max(p.max() for p in kind.positions)) + 1
        kind.bits = [b[:last] for b in kind.bits]
        return kind, float(reached[samples - 1])

    @staticmethod
    def _edited(symbols: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
        out = symbols.tolist()
        for _ in range(edits):
            at, new = int(rng.integers(0, len(out))), int(rng.integers(1, 1 << 62))
            kind = rng.integers(0, 3)
            if kind == 0:
                out[at] = new
            elif kind == 1 and len(out) > 1:
                del out[at]
            else:
                out.insert(at, new)
        return np.array(out, np.uint64)

    def candidates(self, texts: list[np.ndarray]) -> dict[tuple[int, int], set[int]]:
        """(text, item) -> approximate places of every key of the texts that an item has too.

        Short texts are embedded together: a window that runs on into the next text only makes a key of no use.
        """
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        symbols = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        within = np.arange(len(symbols)) - np.repeat(begins[:-1], sizes)
        with np.errstate(over="ignore"):
            for kind in self.classes:
                starts = np.nonzero(within % kind.stride == 0)[0]
                for at in range(0, len(starts), BLOCK):
                    block = starts[at : at + BLOCK]
                    low = int(block[0])
                    part = symbols[low : int(block[-1]) + len(kind.bits[0]) + 1]
                    for keys, _ in kind.keys(part, block - low):
                        hit = np.nonzero(self.table[keys >> _TOP])[0]
                        if not len(hit):
                            continue
                        left, right = (np.searchsorted(self.keys, keys[hit], side) for side in ("left", "right"))
                        for h, x, y in zip(hit[left < right], left[left < right], right[left < right], strict=True):
                            place = int(block[h])
                            text = int(np.searchsorted(begins, place, "right")) - 1
                            for n, start in self.places[x:y].tolist():
                                found[text, n].add(place - int(begins[text]) - start)
            for words, known, entered in self.pieces:
                keys = gram_keys(symbols, words)
                left = np.searchsorted(known, keys, "left")
                same = np.nonzero(known[np.minimum(left, len(known) - 1)] == keys)[0]
                texts_of = np.searchsorted(begins, same, "right") - 1
                for place, text, x in zip(same.tolist(), texts_of.tolist(), left[same].tolist(), strict=True):
                    if place + words > int(begins[text + 1]):
                        continue  # runs on into the next text
                    for y in range(x, int(np.searchsorted(known, known[x], "right"))):
                        n, start = entered[y].tolist()
                        if len(self.items[n][1]) > words or not found[text, n]:  # a piece that is the whole item needs one place
                            found[text, n].add(place - int(begins[text]) - start)
        return found

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, item, fewest edits over its candidate places) for items within their limit."""
        out = []
        for (text, n), places in self.candidates(texts).items():
            symbols, item, limit, done, best = texts[text], self.items[n][1], self.limit[n], -1, None
            for at in sorted(places):
                # A candidate's alignment is off by at most the edits before it, its end by the edits after it.
                begin, end = max(0, at - limit), min(len(symbols), at + len(item) + 2 * limit)
                if end <= done:
                    continue
                done = end + limit
                around = symbols[begin:done]
                # Every item word that is nowhere around costs an edit, so this never hides an occurrence.
                if len(item) - int(np.isin(item, around).sum()) > limit:
                    continue
                edits = edit_distance_within(item, around)
                if edits <= limit and (best is None or edits < best):
                    best = edits
                    if edits == 0:
                        break
            if best is not None:
                out.append((text, n, best))
        return out


def leaked_items(
    entries: DataFrame, trial_items: DataFrame, *, max_edits: float = 0.15, recall: float = 0.99, max_items: int = 10_000, max_item_words: int = 500_000
) -> DataFrame:
    """Rows (``entry_id``, ``item_id``, ``edits``): trial items that an entry contains within ``max_edits`` of their words.

    ``entries`` has ``entry_id`` and ``exact_text``, ``trial_items`` has ``item_id`` and ``text``. Words are lower-case runs of
    letters and digits, so case, punctuation and line breaks do not matter. An item occurs when some part of the whole text
    is within ``floor(max_edits * its words)`` insertions, deletions and replacements of words.

    Candidates come from a random-walk embedding of item-sized windows over every text: edits become differing
    positions, and windows that agree on a few sampled positions share a key. The number of samples follows from
    ``recall`` and the agreement measured on copies of the items with all allowed edits. Items too short for an edit, and
    those for which the samples do not reach ``recall``, are found by exact pieces, which miss none. Each candidate
    place is then checked by exact edit distance against the text around it.

    The index of the items goes to every task. Its size depends on the items only and is checked: more than
    ``max_items`` items or ``max_item_words`` words are worked through in as many passes over the entries as needed, so none is left out.

    Defined cases: items and entries without words match nothing; a null id stays null; repeated entries give
    repeated rows, repeated items are one; empty tables give an empty table. Other columns are not read.
    """
    id_type, item_type = entries.schema["entry_id"].dataType, trial_items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("entry_id", id_type), T.StructField("item_id", item_type), T.StructField("edits", T.LongType())])
    rows, out = entries.select("entry_id", "exact_text"), None
    for sent in _indexes(trial_items, max_edits, recall, max_items, max_item_words):
        found = rows.mapInArrow(_search(sent, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(trial_items: DataFrame, max_edits: float, recall: float, max_items: int, max_item_words: int) -> Iterator:
    """Indexes of bounded size, sent to the tasks, that together hold all distinct items."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    items = trial_items.select("item_id", "text").distinct()
    count, total = items.agg(F.count(F.lit(1)), F.sum(words)).first()
    passes = max(1, -(-count // max_items), -(-(total or 0) // max_item_words))
    for number in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        listed = sorted(((r["item_id"], item_words(r["text"])) for r in part.toLocalIterator()), key=repr)
        yield trial_items.sparkSession.sparkContext.broadcast(ItemIndex(listed, max_edits, recall))


def _matched(batch: pa.RecordBatch, column: int, index: ItemIndex, cache: SymbolCache) -> Iterator[tuple[int, int, int]]:
    """(row of the batch, item number, edits), many short texts at a time."""
    texts, first, held = [], 0, 0
    for last, text in enumerate(batch.column(column), 1):
        if len(cache) > 1_000_000:
            cache.clear()
        texts.append(symbols_of(item_words(text.as_py()), cache))
        held += len(texts[-1])
        if held >= TOGETHER or last == batch.num_rows:
            yield from ((first + t, n, edits) for t, n, edits in index.matches(texts))
            texts, first, held = [], last, 0


def _search(sent, schema: T.StructType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = sent.value, SymbolCache()
        for batch in batches:
            rows = [(batch.column(0)[row].as_py(), index.items[n][0], edits) for row, n, edits in _matched(batch, 1, index, cache)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f) for c, f in zip(zip(*rows, strict=True), _arrow_types(schema), strict=True)], names=schema.names
                )

    return search


def without_leaks(
    entries: DataFrame, trial_items: DataFrame, *, max_edits: float = 0.15, recall: float = 0.99, max_items: int = 10_000, max_item_words: int = 500_000
) -> DataFrame:
    """The entries that contain no trial item, with all their columns, whatever these are called.

    What counts as contained, and all defined cases, are those of ``leaked_items``. One pass per index, nothing is shuffled.
    """
    column = entries.columns.index("exact_text")
    for sent in _indexes(trial_items, max_edits, recall, max_items, max_item_words):
        entries = entries.mapInArrow(_clean_rows(sent, column), entries.schema)
    return entries


def _clean_rows(sent, column: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = sent.value, SymbolCache()
        for batch in batches:
            bad = {row for row, _, _ in _matched(batch, column, index, cache)}
            yield batch.filter(pa.array([row not in bad for row in range(batch.num_rows)], pa.bool_())) if bad else batch

    return clean


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def contaminated_entries(entries: DataFrame, trial_items: DataFrame, **options) -> DataFrame:
    """Per entry that contains a trial item: ``entry_id``, ``items`` (distinct, sorted) and ``edits`` (the fewest)."""
    found = leaked_items(entries, trial_items, **options)
    return found.groupBy("entry_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.min("edits").alias("edits"))
