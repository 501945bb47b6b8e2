"""Toxic spans of review items by a linear-chain conditional random field."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.near_dedup import shingle_hashes, signature

#: Hashed features, longest chain, and features of one token.
FEATURE_BITS, CHAIN, FEATURES = 21, 48, 8
#: Distant token labels: a feature of a toxic item is toxic when it is this much likelier there (natural log), in
#: this many toxic items and this share of them at least.
MIN_ODDS, MIN_ITEMS, MIN_SHARE = 2.5, 4, 0.015
#: Items that must hold a feature for it to have a weight.
MIN_SEEN = 3

_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[^\W\d_]+|[.!?\n]")
_MARKS = frozenset(".!?\n")


def token_features(word: str) -> list[int]:
    """Hashes of the lower-case word, its beginnings of 3 to 7 letters, its last 4 letters and a constant."""
    names = [f"w{word}", f"s{word[-4:]}", "b", *(f"{n}{word[:n]}" if len(word) > n else f"w{word}" for n in range(3, 8))]
    return [xxhash.xxh3_64_intdigest(n) & ((1 << FEATURE_BITS) - 1) for n in names]


def lowered(text: str | None) -> str:
    """The text in lower case with every offset unchanged: a letter that would grow is left as it is."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def pieces(text: str | None) -> list[str]:
    """Words, and between them the marks that end a chain: sentence and line ends."""
    return _PIECE.findall(lowered(text))


def chain_begins(is_word: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a chain: after each mark, and after every ``CHAIN`` words without one."""
    sentence = np.cumsum(~is_word)[is_word]
    place = np.arange(len(sentence))
    first = np.ones(len(sentence), bool)
    first[1:] = sentence[1:] != sentence[:-1]
    place -= np.maximum.accumulate(np.where(first, place, 0))
    return np.nonzero(place % CHAIN == 0)[0]


def _padded(begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Token number per (chain, place), and the chain lengths."""
    sizes = np.diff(np.append(begins, n))
    at = begins[:, None] + np.arange(int(sizes.max()) if len(sizes) else 0)
    return np.minimum(at, max(n - 1, 0)), sizes


def marginals(scores: np.ndarray, begins: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(token is toxic) by forward and backward passes over all chains at once.

    ``scores`` is the log weight of toxic against not for each token, ``transition`` the log weights between the
    two states [from, to]. Every pass is normalised, so chains of any length stay in range.
    """
    if not len(scores):
        return np.zeros(0)
    at, sizes = _padded(begins, len(scores))
    order = np.argsort(-sizes, kind="stable")
    at, sizes = at[order], sizes[order]
    emit = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))[at]  # weight of toxic; of not: 1 - emit
    move, places = np.exp(transition), at.shape[1]
    alive = np.searchsorted(-sizes, -np.arange(places), "left")  # chains with more than k tokens come first
    fore = np.empty((places, len(sizes)))
    fore[0] = emit[:, 0]
    for k in range(1, places):
        n = alive[k]
        p, e = fore[k - 1, :n], emit[:n, k]
        one, zero = e * (p * move[1, 1] + (1 - p) * move[0, 1]), (1 - e) * (p * move[1, 0] + (1 - p) * move[0, 0])
        fore[k, :n] = one / (one + zero)
    back = np.ones(len(sizes)) / 2  # normalised weight of toxic from the right
    out = np.empty(len(scores))
    for k in range(places - 1, -1, -1):
        n = alive[k]
        one, zero = fore[k, :n] * back[:n], (1 - fore[k, :n]) * (1 - back[:n])
        out[at[:n, k]] = one / (one + zero)
        e, b = emit[:n, k], back[:n]
        one, zero = move[1, 1] * e * b + move[1, 0] * (1 - e) * (1 - b), move[0, 1] * e * b + move[0, 0] * (1 - e) * (1 - b)
        back[:n] = one / (one + zero)
    return out


@dataclass
class SpanModel:
    """Feature weights, transitions and the weights from marginals to an item score."""

    weights: np.ndarray
    transition: np.ndarray
    item_weights: np.ndarray

    def score(self, marginal: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(_item_features(marginal) @ self.item_weights, -30, 30))))


def _item_features(marginal: np.ndarray) -> np.ndarray:
    """Constant, evidence of the likeliest token, log of the expected toxic tokens, and log of their share.

    The evidence is -log(1 - marginal), so a certain token counts for more than a likely one.
    """
    most, total = (float(marginal.max()), float(marginal.sum())) if len(marginal) else (0.0, 0.0)
    return np.array([1.0, -np.log(1 - min(most, 1 - 1e-4)), np.log1p(total), np.log1p(100 * total / max(1, len(marginal)))])


class _Featurizer(dict):
    """Word -> number of its row of feature hashes."""

    def __init__(self):
        super().__init__()
        self.rows = array("q")  # 64 bytes a word; lists of numbers would take six times as much of the driver

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        self.rows.extend(token_features(word))
        return self[word]


def fit_span_model(items: list[tuple[str | None, int]], epochs: int = 6, seed: int = 7) -> SpanModel:
    """A model from labelled items (text, toxic 0/1), the same for the same list.

    Tokens of toxic items get their labels from the items: a token is toxic there when one of its features is much
    likelier in toxic items than in others. Every third item is kept from the chain's training and fits the
    weights of the item score, so that the score does not trust what the chain has learnt by heart. Near copies of an
    item already taken are left out.
    """
    feats, docs, seen = _Featurizer(), [], set()
    for text, toxic in items:
        if not _first_of_its_kind(text, seen):
            continue
        parts = pieces(text)
        is_word = np.array([p not in _MARKS for p in parts], bool)
        words = np.fromiter((feats[p] for p in parts if p not in _MARKS), np.int32, int(is_word.sum()))
        docs.append((words, chain_begins(is_word), int(toxic)))
    # Only the features that occur are numbered: arrays over all hashes would be a tenth of the driver's memory.
    hashes, table = np.unique(np.array(feats.rows or [0] * FEATURES, np.int64), return_inverse=True)
    table = table.reshape(-1, FEATURES).astype(np.int32)
    del feats, seen
    counts, totals = (np.zeros(len(hashes)), np.zeros(len(hashes))), [1, 1]
    learn = [d for n, d in enumerate(docs) if n % 3]
    for words, _, toxic in learn:
        np.add.at(counts[toxic], np.unique(table[np.unique(words)]) if len(words) else [], 1)
        totals[toxic] += 1
    odds = np.log((counts[1] + 0.5) / totals[1]) - np.log((counts[0] + 0.5) / totals[0])
    odds[counts[1] < max(MIN_ITEMS, MIN_SHARE * totals[1])] = -9
    marked = (odds[table] >= MIN_ODDS).any(axis=1)

    # A feature of fewer items cannot be told from chance: it keeps the weight 0, as number 0 here.
    known = np.nonzero(counts[0] + counts[1] >= MIN_SEEN)[0]
    number = np.zeros(len(hashes), np.int32)
    number[known] = np.arange(1, len(known) + 1)
    rows_of = number[table]
    weights, transition = np.zeros(len(known) + 1), np.zeros((2, 2))
    squares, moved = np.full(len(known) + 1, 1e-8), np.full((2, 2), 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(learn))
        for at in range(0, len(order), 64):
            batch = [learn[i] for i in order[at : at + 64] if len(learn[i][0])]
            if not batch:
                continue
            words = np.concatenate([d[0] for d in batch])
            label = np.concatenate([marked[d[0]] & bool(d[2]) for d in batch]).astype(float)
            offsets = np.cumsum([0, *(len(d[0]) for d in batch[:-1])])
            begins = np.concatenate([d[1] + o for d, o in zip(batch, offsets, strict=True)])
            rows = rows_of[words]
            p = marginals(weights[rows].sum(axis=1), begins, transition)
            # Gradient of the log likelihood: observed less expected features and transitions.
            slope = np.bincount(rows.ravel(), np.repeat(label - p, FEATURES), len(weights)) - 1e-3 * weights
            slope[0] = 0
            squares += slope**2
            weights += 0.3 * slope / np.sqrt(squares)
            linked = np.ones(len(words), bool)
            linked[begins] = False
            now = np.nonzero(linked)[0]
            if len(now):
                change = _steps(label, now) - _steps(p, now)
                moved += change**2
                transition += 0.05 * change / np.sqrt(moved)
    table = rows_of
    transition = np.clip(transition, -3, 3)
    rest = [d for n, d in enumerate(docs) if n % 3 == 0]
    x = np.array([_item_features(marginals(weights[table[w]].sum(axis=1) if len(w) else np.zeros(0), b, transition)) for w, b, _ in rest]).reshape(-1, 4)
    y, item = np.array([d[2] for d in rest], float), np.zeros(4)
    for _ in range(30):  # regularised logistic regression by Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ item, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        item += np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * item)
    spread = np.zeros(1 << FEATURE_BITS, np.float32)
    spread[hashes[known]] = weights[1:]
    return SpanModel(spread, transition, item)


def _steps(x: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Mean weight of each step [from, to] between neighbours of a chain."""
    before, after = x[now - 1], x[now]
    return np.array([[np.mean(f * t) for t in (1 - after, after)] for f in (1 - before, before)])


def _first_of_its_kind(text: str | None, seen: set) -> bool:
    """False for near copies of an item already taken: their words would pass for signs of its label."""
    shingles = shingle_hashes(text)
    values = signature(shingles)[:8].tolist() if len(shingles) else []
    marks = set(enumerate(values))
    if len(marks & seen) >= 3:
        return False
    seen |= marks
    return True


def training_items(review_items: DataFrame, labels: DataFrame, *, max_items: int = 6000) -> list[tuple[str | None, int]]:
    """A bounded sample of labelled items: at most ``max_items``, half of them of either label as far as there are as many.

    The sample is the items with the smallest hash of their id, so it does not depend on layout or order. Whole texts are taken.
    """
    known = labels.where("toxic is not null and item_id is not null").groupBy("item_id").agg(F.max("toxic").alias("toxic"))
    rows = review_items.select("item_id", "source_text").where("item_id is not null")
    # The ids are chosen before any text moves.
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("item_id"), "item_id").limit(max_items // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = rows.join(F.broadcast(chosen), "item_id").select("item_id", "source_text", "toxic")
    listed = sorted(((r["item_id"], r["source_text"] or "", r["toxic"]) for r in sample.toLocalIterator()), key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[1]))
    return [(text, toxic) for _, text, toxic in listed]


def toxic_spans(review_items: DataFrame, labels: DataFrame, *, threshold: float = 0.7, span_at: float = 0.5, max_items: int = 6000) -> DataFrame:
    """Per review item: ``item_id``, ``score``, ``predicted`` and ``spans`` (``start``, ``end``, ``marginal``).

    ``labels`` has ``item_id`` and ``toxic`` for the items that may be learnt from; at most ``max_items`` of them (a
    documented bound, the sample goes to the driver) fit the model, which is sent to every task: 8 MiB. Scores read the
    text alone. A linear chain over the words of a sentence (sentences and lines end a chain, and every 48 words) tags
    words as toxic; the marginals of its forward and backward passes are aggregated to a score in 0..1 by their largest
    value, sum and share, and neighbouring words at ``span_at`` or more are one span of code points with their largest marginal.

    Defined cases: null and empty texts, and texts without letters, get the score of an item without tokens; repeated rows
    get equal results; an id with several label rows is toxic if one says so; without labels every score is the
    prior of an untrained model; an empty table gives an empty table. Other columns are not read.
    """
    sent = _fitted(review_items, labels, max_items)
    id_type = review_items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {id_type}, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores, spans in _scored(batches, 1, sent.value, span_at):
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(spans, span_type)],
                names=["item_id", "score", "predicted", "spans"],
            )

    return review_items.select("item_id", "source_text").mapInArrow(tag, schema)


def without_toxic(review_items: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_items: int = 6000) -> DataFrame:
    """The review items whose score is below ``threshold``, with all their columns, whatever these are called.

    Model, score and defined cases are those of ``toxic_spans``. One pass, nothing is shuffled.
    """
    sent, column = _fitted(review_items, labels, max_items), review_items.columns.index("source_text")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores, _ in _scored(batches, column, sent.value, 2.0):
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return review_items.mapInArrow(below, review_items.schema)


def _fitted(review_items: DataFrame, labels: DataFrame, max_items: int):
    model = fit_span_model(training_items(review_items, labels, max_items=max_items))
    return review_items.sparkSession.sparkContext.broadcast(model)


def _scored(batches: Iterator[pa.RecordBatch], column: int, model: SpanModel, span_at: float) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Each batch with the scores and spans of its texts."""
    emission = _Emission(model.weights)
    for batch in batches:
        scores, spans = [], []
        for at in range(0, batch.num_rows, 128):
            if len(emission) > 1_000_000:
                emission = _Emission(model.weights)
            texts = [lowered(t.as_py()) for t in batch.column(column)[at : at + 128]]
            p, offsets = tagged(texts, emission, model.transition)
            for text, low, high in zip(texts, offsets[:-1], offsets[1:], strict=True):
                scores.append(model.score(p[low:high]))
                spans.append(_merged(p[low:high], text, span_at))
        yield batch, scores, spans


class _Emission(dict):
    """Word -> log weight of toxic, remembered while there is room; not a number for the marks that end a chain."""

    def __init__(self, weights: np.ndarray):
        super().__init__(dict.fromkeys(_MARKS, float("nan")))
        self._weights = weights

    def __missing__(self, word: str) -> float:
        value = self[word] = float(self._weights[token_features(word)].sum())
        return value


def tagged(texts: list[str], emission: _Emission, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the words of all texts in a row, and where each text's words begin and end."""
    parts, ends = [], []
    for text in texts:
        parts += _PIECE.findall(text)
        parts.append("\n")
        ends.append(len(parts))
    value = np.fromiter(map(emission.__getitem__, parts), float, len(parts))
    is_word = ~np.isnan(value)
    before = np.concatenate([[0], np.cumsum(is_word)])
    return marginals(value[is_word], chain_begins(is_word), transition), before[np.array([0, *ends])]


def _merged(p: np.ndarray, text: str, span_at: float) -> list[dict]:
    toxic = np.nonzero(p >= span_at)[0].tolist()
    if not toxic:
        return []
    out, last, places = [], None, [m.span() for m in _WORD.finditer(text)]
    for n in toxic:
        if last is not None and n == last + 1:
            out[-1]["end"], out[-1]["marginal"] = places[n][1], max(out[-1]["marginal"], float(p[n]))
        else:
            out.append({"start": places[n][0], "end": places[n][1], "marginal": float(p[n])})
        last = n
    return out


def held_out(item_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.pmod(F.crc32(item_id.cast("string").cast("binary")), F.lit(3)) == 1
