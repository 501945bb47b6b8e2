"""Line, near and exact duplicates against plain computation on small tables."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.components import components, dealt_join
from plumbline.llm.exact_dedup import exact_duplicates
from plumbline.llm.line_dedup import drop_boilerplate_lines, host_of
from plumbline.session import Scratch
from plumbline.llm.near_dedup import near_duplicates, shingle_hashes, signature

ENTRY = "entry_id long, exact_text string"


def test_boilerplate_is_relative_to_its_host(spark):
    rows = [(n, f"https://A.example/{n}", f"Menu \nown {n}\n\nline {n % 7}") for n in range(40)]
    rows += [(100 + n, "https://b.example/x", f"Menu\nother {n}" if n < 2 else f"text {n}\nmore {n}") for n in range(60)]
    done = {r.evidence_id: r for r in drop_boilerplate_lines(spark.createDataFrame(rows, "evidence_id long, source_locator string, extraction string"), max_ratio=0.2).collect()}
    assert done[3].extraction == "own 3\n\nline 3" and (done[3].n_lines, done[3].n_dropped) == (3, 1)
    assert done[100].extraction == "Menu\nother 0" and done[100].n_dropped == 0  # 2 of 60 pages of this host


def test_line_dedup_edge_cases(spark):
    page = "same\nall of it"
    rows = [(n, "h", page, "x", 9) for n in range(10)]  # copies are one page: no evidence of boilerplate
    rows += [(20, None, "a\nb", None, None), (21, "h", None, "x", None), (22, "h", "", "x", None), (None, "h", "unique", "x", None), (23, "h", "y" * 300_000, "x", 1)]
    rows += [(23, "h", "y" * 300_000, "x", 1)]
    frame = spark.createDataFrame(rows, "evidence_id long, source_locator string, extraction string, host string, n_dropped int")
    out = drop_boilerplate_lines(frame)
    assert out.columns == ["evidence_id", "source_locator", "extraction", "host", "n_lines", "n_dropped"]
    got = sorted(((r.evidence_id, r.extraction, r.n_dropped) for r in out.collect()), key=repr)
    assert got == sorted(((r[0], r[2], 0) for r in rows), key=repr)
    assert drop_boilerplate_lines(frame.limit(0)).count() == 0


def test_page_of_boilerplate_alone_is_emptied(spark):
    rows = [(f"EV-{n}", "h", f"frame\nmenu\nbody {n}") for n in range(8)] + [("EV-8", "h", "frame\nmenu"), ("EV-9", "h", "menu\n\nframe")]
    rows += [("EV-a", "two", "both\none"), ("EV-b", "two", "both\nother"), ("EV-c", "one", "alone")]  # on both pages of a host of two
    out = {r.evidence_id: (r.extraction, r.n_lines, r.n_dropped) for r in drop_boilerplate_lines(spark.createDataFrame(rows, "evidence_id string, source_locator string, extraction string")).collect()}
    assert (out["EV-0"], out["EV-8"], out["EV-9"]) == (("body 0", 3, 2), ("", 2, 2), ("", 2, 2))
    assert (out["EV-a"], out["EV-b"], out["EV-c"]) == (("one", 2, 1), ("other", 2, 1), ("alone", 1, 0))


def test_host(spark):
    rows = [("HTTP://u:p@Www.Ex.org:80/a?b",), ("src7",), (None,), ("https://x.org",)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(host_of(F.col("l"))).collect()]
    assert got == ["www.ex.org", "src7", None, "x.org"]


def _similar(x, y):
    shared = len(np.intersect1d(x, y))
    return bool(shared) and 100 * shared >= 75 * (len(x) + len(y) - shared)


def _brute(texts):
    sets = {i: shingle_hashes(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if label[a] != label[b] and (_similar(sets[a], sets[b]) if a != b else False):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def _group(rng, size, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
        yield " ".join(words)


@pytest.mark.parametrize("region", [1_000_000, 1500])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, region):
    """Also with regions so small that the forest has to go deeper."""
    monkeypatch.setattr("plumbline.llm.near_dedup.REGION", region)
    monkeypatch.setattr("plumbline.llm.near_dedup.FEW", 4)
    rng = random.Random(5)
    texts = [t for size, edits in ((2, 1), (3, 2), (25, 4), (6, 9), (1, 0), (1, 0)) for t in _group(rng, size, edits)]
    texts += ["", "two words", "Two  WORDS", "two words more", texts[0].upper()]
    listed = dict(enumerate(texts, 10))
    got = {r.entry_id: r for r in near_duplicates(spark.createDataFrame([*listed.items()], ENTRY)).collect()}
    want = _brute(listed)
    wrong = [i for i in listed if got[i].component_id != want[i]]
    assert not wrong
    assert all(got[i].n_shingles == len(shingle_hashes(t)) and got[i].kept == (got[i].component_id == i) for i, t in listed.items())


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"word{n}" for n in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (7, long), (8, long + " x"), (9, " \t\n")]
    frame = spark.createDataFrame(rows, ENTRY).selectExpr("*", "1 as component", "'x' as id", "2 as region")
    got = sorted(((r.entry_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (None, 2, None, True), (7, 29_996, 7, True), (8, 29_997, 7, False), (9, 0, 9, True)]
    assert got == sorted([(i, n, c, k if i is not None else True) for i, n, c, k in want], key=repr)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_shingles_and_signature():
    assert len(shingle_hashes("a b c d e")) == 1 and len(shingle_hashes("a b c")) == 1 and len(shingle_hashes(None)) == 0
    assert np.array_equal(shingle_hashes("A  b\tc\x0bD e F"), shingle_hashes("a b c d e f"))
    assert not np.array_equal(shingle_hashes("a b c"), shingle_hashes("a b c"))
    x, y = (shingle_hashes(" ".join(f"t{n}" for n in r)) for r in (range(0, 900), range(100, 1000)))
    assert abs((signature(x) == signature(y)).mean() - 796 / 996) < 0.15


def test_components(spark):
    chain = [(n, n + 1) for n in range(200, 220)]
    star = [(5, n) for n in range(100, 160)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain + star + [(9, 9), (3, 2), (2, 3)], "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{n: 200 for n in range(200, 221)}, **{n: 5 for n in [5, *range(100, 160)]}, 2: 2, 3: 2}


def test_components_of_a_star_with_hot_centre(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.components.HOT_ROWS", 10)
    links = [("m", f"x{n:03d}") for n in range(150)] + [("x000", "a"), ("y1", "y2")]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a string, b string"), Scratch(spark)).collect()}
    assert got == {**{n: "a" for n in ["a", "m", *(f"x{n:03d}" for n in range(150))]}, "y1": "y1", "y2": "y1"}


def test_dealt_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.components.HOT_ROWS", 5)
    rows = spark.createDataFrame([(n % 3 if n < 60 else 7, n) for n in range(70)] + [(None, 99)], "k int, v int")
    facts = rows.groupBy("k").agg(F.count("v").alias("size"), F.max("v").alias("top")).where("k <> 2")
    got = sorted((r.k, r.v, r.top) for r in dealt_join(rows, facts, "k", "size", 71).collect())
    assert got == sorted((k, v, {0: 57, 1: 58, 7: 69}[k]) for k, v in [(n % 3 if n < 60 else 7, n) for n in range(70)] if k != 2)


def test_near_duplicates_of_named_entries(spark):
    rng = random.Random(11)
    texts = [t for size, edits in ((3, 2), (4, 3), (1, 0)) for t in _group(rng, size, edits)]
    rows = [(f"rvl-{n:024x}", t) for n, t in enumerate(texts)] + [("rvl-x", texts[0]), ("rvl-x", texts[-1]), (None, texts[0])]
    got = {(r.entry_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "entry_id string, exact_text string")).collect()}
    label = lambda n: f"rvl-{n:024x}"
    want = {(label(n), label(0 if n < 3 else 3), n in (0, 3)) for n in range(7)} | {(label(7), label(0), False), ("rvl-x", label(0), False), (None, None, True)}
    assert got == want  # the id with two texts links the groups of both


def test_crowded_group_keeps_its_links(spark, monkeypatch):
    """A crowd that shares a passage, with pairs at and below the border: no link lost, none invented, whole or in tiles."""
    monkeypatch.setattr("plumbline.llm.near_dedup.REGION", 4000)
    rng = random.Random(21)
    passage = [f"p{n}" for n in range(60)]
    texts = {}
    for n in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(40)]
        texts[2 * n] = " ".join(passage + own)
        texts[2 * n + 1] = " ".join(passage + own[: 40 - rng.randrange(20)] + [f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(8))])
    got = {r.entry_id: r.component_id for r in near_duplicates(spark.createDataFrame([*texts.items()], ENTRY)).collect()}
    assert got == _brute(texts)


def test_crowded_region_without_deeper_crowds_is_counted_out(spark, monkeypatch):
    """The first two texts are linked and share four values in one crowded region that the third leads, and nowhere six."""
    monkeypatch.setattr("plumbline.llm.near_dedup.REGION", 10)
    monkeypatch.setattr("plumbline.llm.near_dedup.FEW", 2)
    monkeypatch.setattr("plumbline.llm.near_dedup.SHALLOW", 1)
    rng = random.Random(2642)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = new(90)
    texts = dict(enumerate([" ".join(base), " ".join(base[:78] + new(12)), " ".join(new(16) + base[16:])]))
    want = _brute(texts)
    assert want == {0: 0, 1: 0, 2: 2}
    assert {r.entry_id: r.component_id for r in near_duplicates(spark.createDataFrame([*texts.items()], ENTRY)).collect()} == want


def test_lonely_entries_of_large_shallow_runs_are_compared(spark, monkeypatch):
    """Two linked texts that share three values in some orders and nowhere four, where a run of three is already too large for a region."""
    monkeypatch.setattr("plumbline.llm.near_dedup.SHALLOW", 1)
    rng = random.Random(9027)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = new(90)
    texts = dict(enumerate([" ".join(base), " ".join(base[:78] + new(12)), "other words"]))
    want = _brute(texts)
    assert want == {0: 0, 1: 0, 2: 2}
    assert {r.entry_id: r.component_id for r in near_duplicates(spark.createDataFrame([*texts.items()], ENTRY)).collect()} == want


def test_exact_duplicates_equal_plain_grouping(spark):
    rows = [(n, t) for n, t in enumerate(["a", "A", "Ä", "ä", "", None, "b" * 200_000, "B" * 200_000, "İ", "x\ny", "X\nY", "a"])]
    rows += [(None, "a"), (None, "alone"), (0, "a")]
    frame = spark.createDataFrame(rows, ENTRY).selectExpr("*", "1 as text", "2 as digest").repartition(5)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    want = []
    for i, t in rows:
        members = groups[(t or "").translate(low)]
        keep = max((m for m in members if m is not None), default=None)
        want.append((i, keep, len(members), i == keep, hashlib.sha256((t or "").translate(low).encode()).hexdigest()))
    assert sorted(map(tuple, exact_duplicates(frame).collect()), key=repr) == sorted(want, key=repr)
    assert exact_duplicates(frame.limit(0)).count() == 0


def test_equal_digests_do_not_merge_texts(spark, monkeypatch):
    """With a digest that says nothing, texts still decide."""
    import plumbline.llm.exact_dedup as module

    class Weak:
        def __getattr__(self, name):
            return (lambda *_: F.lit("00")) if name == "sha2" else getattr(F, name)

    monkeypatch.setattr(module, "F", Weak())
    frame = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "b")], ENTRY)
    got = sorted((r.entry_id, r.keep_id, r.group_size) for r in exact_duplicates(frame).collect())
    assert got == [(1, 2, 2), (2, 2, 2), (3, 5, 2), (4, 4, 1), (5, 5, 2)]
