"""Periodic runs and the source mix against plain computation."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm.queries import LLM_QUERIES
from plumbline.llm.repeat_runs import APPENDED, SquareCatchers, periodic_runs, runs_of_words
from plumbline.llm.source_mix import cyclic_weights, mix_sources, water_level

FOLDER = "/root/testdata/sf0.001"


def plain_runs(x, min_words=24, min_periods=3):
    """All stretches of words equal to those q later, for every q; those with a smaller period drop out."""
    out, n = [], len(x)
    for q in range(1, n // min_periods + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and x[end] == x[end + q]:
                end += 1
            if end > at and end + q - at >= max(min_words, min_periods * q):
                part = x[at : end + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((at, end + q - at, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    if rng.random() < 0.4:
        return [rng.randrange(rng.choice([2, 5])) for _ in range(rng.randrange(200))]
    out, wanted = [], rng.randrange(1, 200)
    while len(out) < wanted:
        block = [rng.randrange(rng.choice([2, 30])) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 33]))]
        out += (block * 8)[: rng.randrange(1, len(block) * 6 + 2)] + [99] * (rng.random() < 0.4)
    return out


@pytest.mark.parametrize(("min_words", "min_periods"), [(24, 3), (2, 2), (10, 2), (30, 4)])
def test_catchers_equal_plain_search_however_words_are_appended(min_words, min_periods):
    rng = random.Random(min_words)
    for _ in range(150):
        x = repetitive(rng)
        want = plain_runs(x, min_words, min_periods)
        assert runs_of_words(x, min_words, min_periods) == want
        catchers, at = SquareCatchers(min_words, min_periods), 0
        while at < len(x):
            step = rng.choice([1, 1, 2, 7, 40])
            catchers.append(np.array(x[at : at + step]))
            at += step
        assert catchers.finish() == want


def test_squares_are_reported_as_they_are_completed():
    catchers = SquareCatchers(4, 2)
    told = [catchers.append(np.array([w])) for w in [7, 1, 2, 1, 2, 1, 9]]
    assert told == [[], [], [], [], [(1, 4, 2)], [(1, 5, 2)], []] and catchers.finish() == [(1, 5, 2)]


def test_long_texts_take_little_time():
    rng = np.random.default_rng(3)
    assert runs_of_words([0] * 600_000) == [(0, 600_000, 1)]
    block = rng.integers(0, 1000, 50_000).tolist()
    assert runs_of_words(block * 4) == [(0, 200_000, 50_000)]
    assert runs_of_words(([0] * 50 + [1]) * (2 * APPENDED // 51))[0] == (0, 50, 1)


def _contract_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words) if len(words) < 700 else runs_of_words(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_op11_equals_plain_computation(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = LLM_QUERIES["op11_periodic_runs"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted((_contract_row(r.doc_id, r.text) for r in given), key=str)
    assert sum(r[1] > 0 for r in rows) > 5


def test_runs_defined_cases(spark):
    looped = "start " + "a b c " * 9 + "end"
    rows = [("rvl-1", None, 1), ("rvl-2", "", 2), ("rvl-3", looped, 3), ("rvl-3", looped, 3), (None, "one\ttwo\n", 4), ("rvl-4", "w " * 300_000, 5)]
    got = periodic_runs(spark.createDataFrame(rows, "entry_id string, exact_text string, runs int")).collect()
    seen = sorted((str(r.entry_id), r.n_words, [tuple(x) for x in r.runs], r.strongest_run and tuple(r.strongest_run), r.collapsed_text) for r in got)
    loop = ("rvl-3", 29, [(1, 27, 3)], (1, 27, 3), "start a b c end")
    assert seen == [("None", 2, [], None, "one two"), ("rvl-1", 0, [], None, ""), ("rvl-2", 0, [], None, ""), loop, loop, ("rvl-4", 300_000, [(0, 300_000, 1)], (0, 300_000, 1), "w")]
    assert periodic_runs(spark.createDataFrame([], "entry_id string, exact_text string")).count() == 0


# -- mixing


EVIDENCE = "evidence_id string, source_locator string, extraction string, weight string"


def test_mix_serves_every_source_near_its_target(spark):
    rng = random.Random(4)
    sizes = [("hot", 400, 60), ("long", 3, 5000), ("small", 2, 20), (None, 50, 30), ("empty", 3, 0)]
    rows = [(f"E{k}-{n}", k, "w " * rng.randrange(most // 2, most + 1), "x") for k, count, most in sizes for n in range(count)]
    evidence = spark.createDataFrame(rows, EVIDENCE).repartition(5)
    weights = cyclic_weights(evidence)
    assert {r.source_locator: r.weight for r in weights.collect()} == {"empty": 5, "hot": 2, "long": 1, "small": 5, None: 2}
    got = mix_sources(evidence, weights, quantum=16).collect()
    words = {r[0]: len(r[2].split()) for r in rows}
    assert len(got) == len(rows) and all(r.size == words[r.evidence_id] and 0 <= r.taken <= 2 * r.size for r in got)
    total, by = sum(words.values()), {}
    for row, r in [(next(x for x in rows if x[0] == r.evidence_id), r) for r in got]:
        taken, _ = by.get(row[1], (0, 0))
        by[row[1]] = (taken + r.taken, r.target)
    assert all(abs(taken - target) <= 16 for taken, target in by.values())
    assert sum(taken for taken, _ in by.values()) == total * 150 // 100
    again = mix_sources(evidence.repartition(2), weights, quantum=16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_defined_cases(spark):
    rows = [("a", "s", "one two", None), ("a", "s", "one two", None), (None, "s", None, None), ("b", "t", "", None), ("c", "t", "w " * 300_000, None)]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    got = sorted((str(r.evidence_id), r.size, r.source_size, r.taken) for r in mix_sources(evidence, cyclic_weights(evidence)).collect())
    # The small source is served up to twice its words, the other has the rest of 150 %.
    assert got == [("None", 0, 4, 0), ("a", 2, 4, 4), ("a", 2, 4, 4), ("b", 0, 300_000, 0), ("c", 300_000, 300_000, 450_006 - 8)]
    unweighted = mix_sources(evidence, spark.createDataFrame([("s", 1)], "source_locator string, weight int"))
    assert {(r.evidence_id, r.taken, r.target) for r in unweighted.collect()} == {("a", 4, 8.0), (None, 0, 8.0), ("b", 0, 0.0), ("c", 0, 0.0)}
    none = spark.createDataFrame([], EVIDENCE)
    assert mix_sources(none, cyclic_weights(none)).count() == 0
    blank = spark.createDataFrame([("a", "s", " ", None)], EVIDENCE)
    assert [(r.taken, r.target) for r in mix_sources(blank, cyclic_weights(blank)).collect()] == [(0, 0.0)]


def test_water_level(spark):
    frame = lambda rows: spark.createDataFrame(rows, "cap long, weight int").selectExpr("cap", "cast(weight as decimal(28,9)) as weight")
    assert water_level(frame([(10, 5), (100, 5), (100, 1)]), 120) == pytest.approx(110 / 6, rel=0.1)
    level = water_level(frame([(10, 5), (60, 5), (100, 1)]), 120)
    assert sum(min(c, w * level) for c, w in [(10, 5), (60, 5), (100, 1)]) == pytest.approx(120)
    assert water_level(frame([(10, 5), (20, 5)]), 40) is None
