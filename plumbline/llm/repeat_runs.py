"""Periodic runs in verbatim entries, caught online from squares over dyadic blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words appended at once; window hashes of earlier words are dropped as soon as no catcher needs them.
APPENDED = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Level:
    """Hashes of all windows of ``block`` words, and the catchers over the completed blocks of that length.

    The catcher over the block that begins at word s waits for the block to come again at s + q for the periods q of this level.
    """

    def __init__(self, block: int, low: int, high: int):
        self.block, self.low, self.high = block, low, high  # periods low <= q < high; none if low >= high
        self.kept_from, self.hashes = 0, np.zeros(0, np.uint64)

    @property
    def count(self) -> int:
        return self.kept_from + len(self.hashes)

    def window(self, start: int, stop: int) -> np.ndarray:
        return self.hashes[start - self.kept_from : stop - self.kept_from]

    def add(self, hashes: np.ndarray) -> None:
        self.hashes = np.concatenate([self.hashes, hashes]) if len(self.hashes) else hashes

    def caught(self, since: int) -> tuple[np.ndarray, np.ndarray]:
        """Periods and block starts of the blocks that come again in a window beginning at word ``since`` or later."""
        periods, blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts = np.arange(since, self.count)
        if len(starts) and self.low < self.high:
            now, newest = self.window(since, self.count), (starts - self.low) // self.block
            for back in range((self.high - 1 - self.low) // self.block + 1):
                block = (newest - back) * self.block
                at = np.nonzero((block >= 0) & (starts - block < self.high))[0]
                at = at[now[at] == self.hashes[block[at] - self.kept_from]]
                periods.append(starts[at] - block[at])
                blocks.append(block[at])
        return np.concatenate(periods), np.concatenate(blocks)

    def forget(self) -> None:
        """Keep what a later window is compared with, and what the next level may still be built from."""
        first = max(self.kept_from, self.count - 8 * self.block - self.high)
        self.hashes = self.hashes[first - self.kept_from :].copy()
        self.kept_from = first


class SquareCatchers:
    """Runs of a growing sequence of words: at least ``min_periods`` smallest periods and ``min_words`` words, extended as far as they go.

    Blocks of 2, 4, 8, ... words are completed as the sequence grows. A run of period q holds two times ``min_periods - 1`` whole periods
    of equal words q apart, and so a completed block, of the largest size for that period, that comes again q words later: each appended
    word ends one window per level, which is compared with the catchers in whose reach it is (a constant number). A block that comes again
    is extended word by word to both sides. The stretch is a square as soon as it is q long, and squares of one period that overlap are
    one run; a stretch that reaches the end of the sequence stays open and grows with the words appended later. Blocks and copies that lie in one
    stretch of a period dividing q say nothing new and are passed over. Results do not depend on how the words are dealt over calls.
    """

    def __init__(self, min_words: int = 24, min_periods: int = 3):
        if min_periods < 2 or min_words < 2:
            raise ValueError("a run has two periods and two words at least")
        self._min_words, self._min_periods = min_words, min_periods
        self._least = max(1, (min_periods - 1) * min_words // min_periods)  # equal words of the shortest run
        self._words = np.zeros(0, np.int64)
        self._levels: list[_Level] = []
        self._open: list[tuple[int, int, int]] = []  # period, first word, equal words, of stretches that reach the end
        self._known: dict[int, list[tuple[int, int]]] = {}  # period: (first word, end) of runs and open stretches
        self.runs: list[tuple[int, int, int]] = []  # start, length, period

    def _level(self, n: int) -> _Level:
        """Level of blocks of ``2 ** n`` words with the periods for which it is the largest that a run must hold."""
        block, steps = 1 << n, self._min_periods - 1
        low = 1 if 2 * block - 1 <= self._least < 4 * block - 1 else -(-(2 * block - 1) // steps)
        high = -(-(4 * block - 1) // steps)
        return _Level(block, low, high if 4 * block - 1 > self._least else low)

    def _needs(self, level: _Level) -> int:
        return max(self._min_words, self._min_periods * level.low) if level.low < level.high else level.block

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Append word codes; returns (start, length, period) of the stretches that hold a square which the new words completed or extended."""
        self._words = np.concatenate([self._words, np.asarray(words, np.int64)])
        total, grown = len(self._words), {}
        for period, first, equal in self._open:
            more = self._equal_right(first + equal, period)
            if more:
                grown[period, first] = equal + more
            self._close(period, first, equal + more)
        self._open = [(p, f, grown.get((p, f), e)) for p, f, e in self._open if f + grown.get((p, f), e) + p == total]
        found: list[tuple[_Level, np.ndarray, np.ndarray]] = []
        n = 0
        while n < len(self._levels) or self._needs(self._level(n)) <= total:
            if n == len(self._levels):
                self._levels.append(self._level(n))
            level, since = self._levels[n], self._levels[n].count
            until = total - level.block + 1
            if until > since:
                if n == 0:
                    level.add(_mixed(self._words[since:].astype(np.uint64) + _MIX))
                else:
                    half, by = self._levels[n - 1], level.block // 2
                    with np.errstate(over="ignore"):
                        level.add(_mixed(half.window(since, until) * _MIX + half.window(since + by, until + by)))
                found.append((level, *level.caught(since)))
            n += 1
        for level in self._levels:
            level.forget()
        for level, periods, starts in found:
            for divisor in [p for p in self._known if p < level.low]:
                if not len(periods):
                    break
                told = np.flatnonzero(periods % divisor == 0)
                told = told[self._covered(divisor, starts[told], starts[told] + periods[told] + level.block)]
                periods, starts = np.delete(periods, told), np.delete(starts, told)
            order = np.lexsort((starts, periods))
            periods, starts = periods[order], starts[order]
            edges = np.flatnonzero(np.diff(periods, prepend=-1, append=-1))
            for low, high in pairwise(edges.tolist()):
                self._extend(int(periods[low]), starts[low:high], level, grown)
        return sorted((f, e + p, p) for (p, f), e in grown.items() if e >= p)

    def _covered(self, period: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a known stretch of that period holds all words from start to end."""
        firsts, lasts = np.array(sorted(self._known[period])).T
        inside = np.searchsorted(firsts, starts, "right") - 1
        return (inside >= 0) & (lasts[inside] >= ends)

    def _extend(self, period: int, starts: np.ndarray, level: _Level, grown: dict) -> None:
        block = level.block
        for divisor in [p for p in self._known if p >= level.low and period % p == 0]:
            starts = starts[~self._covered(divisor, starts, starts + period + block)]
        last = -1
        for start in starts.tolist():
            if start + block <= last:
                continue
            left = self._equal_left(start, period)
            first = start - left
            equal = left + self._equal_right(start, period)
            if equal < left + block:
                continue  # equal hashes of unequal windows
            last = first + equal
            if last + period == len(self._words):
                self._open.append((period, first, equal))
                self._known.setdefault(period, []).append((first, last + period))
                grown[period, first] = equal
            else:
                if self._close(period, first, equal, new=True):
                    grown[period, first] = equal

    def _close(self, period: int, first: int, equal: int, new: bool = False) -> bool:
        """A stretch that has ended becomes a run if it is long enough, and is forgotten if not."""
        end = first + equal + period
        known = self._known.get(period, [])
        if not new:
            known[:] = [(f, e if f != first else end) for f, e in known]
            if end == len(self._words):
                return False
        long_enough = end - first >= max(self._min_words, self._min_periods * period)
        if long_enough:
            self.runs.append((first, end - first, period))
            if new:
                self._known.setdefault(period, []).append((first, end))
        elif not new:
            known[:] = [k for k in known if k[0] != first]
            if not known:
                self._known.pop(period)
        return long_enough

    def _equal_right(self, at: int, period: int) -> int:
        """How many words from ``at`` on equal those ``period`` words later."""
        words, count, size = self._words, 0, 32
        while at + count + period < len(words):
            here = words[at + count : at + count + size]
            there = words[at + count + period : at + count + period + size]
            unequal = np.flatnonzero(here[: len(there)] != there)
            if len(unequal):
                return count + int(unequal[0])
            count, size = count + len(there), size * 2
        return count

    def _equal_left(self, at: int, period: int) -> int:
        """How many words before ``at`` equal those ``period`` words later."""
        words, count, size = self._words, 0, 32
        while count < at:
            low = max(0, at - count - size)
            unequal = np.flatnonzero(words[low : at - count] != words[low + period : at - count + period])
            if len(unequal):
                return at - 1 - (low + int(unequal[-1]))
            count, size = at - low, size * 2
        return count

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of the whole sequence by start, then period."""
        ended = [(f, e + p, p) for p, f, e in self._open if e + p >= max(self._min_words, self._min_periods * p)]
        return sorted(self.runs + ended, key=lambda r: (r[0], r[2]))


def runs_of_words(words: list, min_words: int = 24, min_periods: int = 3) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a list of words."""
    if len(words) < min_words:
        return []
    codes: dict = {}
    known = codes.setdefault
    numbers = np.fromiter((known(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) == len(words):
        return []
    catchers = SquareCatchers(min_words, min_periods)
    for at in range(0, len(numbers), APPENDED):
        catchers.append(numbers[at : at + APPENDED])
    return catchers.finish()


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with most periods, exactly; of equals the smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _structs(rows: list[tuple | None]) -> pa.StructArray:
    columns = [pa.array([None if r is None else r[k] for r in rows], pa.int64()) for k in range(3)]
    return pa.StructArray.from_arrays(columns, fields=list(_RUN), mask=pa.array([r is None for r in rows], pa.bool_()))


def periodic_runs(entries: DataFrame, *, min_words: int = 24, min_periods: int = 3) -> DataFrame:
    """Per entry: ``entry_id``, ``n_words``, ``runs``, ``strongest_run``, ``collapsed_text``.

    ``entries`` are verbatim entries with ``entry_id`` (any type) and ``exact_text``. Words are what ASCII white space leaves, numbered from
    0. A run (``start``, ``length``, ``period``) is a stretch of words with that smallest period, of at least ``min_periods`` periods and ``min_words``
    words, that no neighbouring word extends; ``runs`` has all of them by start, then period, found by ``SquareCatchers``. ``strongest_run`` is the
    one with the greatest exact length / period (ties: smallest start, then period), null without a run. ``collapsed_text`` joins by one space
    the words that no run repeats: a word in a run after the run's first period is left out.

    No shuffle; a text of n words takes O(n log n) time when its repeats are runs, and memory in proportion to its words.

    Defined cases: a null text is empty; an empty text has 0 words, no runs and an empty collapsed text; repeated rows and a null id get one
    result each; an empty table gives an empty table. Other columns are not read.
    """
    id_type = entries.schema["entry_id"].dataType.simpleString()
    run = "struct<start:long,length:long,period:long>"
    schema = f"entry_id {id_type}, n_words long, runs array<{run}>, strongest_run {run}, collapsed_text string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, ends, best, collapsed = [], [], [0], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                runs = runs_of_words(words, min_words, min_periods)
                if runs:
                    keep = np.ones(len(words), bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                sizes.append(len(words))
                found += runs
                ends.append(len(found))
                best.append(_strongest(runs) if runs else None)
                collapsed.append(b" ".join(kept if runs else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _structs(found)), _structs(best), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["entry_id", "n_words", "runs", "strongest_run", "collapsed_text"],
            )

    return entries.select("entry_id", "exact_text").mapInArrow(find, schema)
