"""Near duplicates of verbatim entries by a MinHash forest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components, dealt_join
from plumbline.session import Scratch

#: Values of a signature; orders of the forest; values of a label by which an order is sorted. A pair at similarity 0.75 shares no
#: four leading values in any order with probability (1 - 0.75 ** 4) ** 24 = 1.1e-4; at 0.8 with 3.3e-6.
VALUES, ORDERS, LABEL = 96, 24, 8
#: Leading values at which runs of a sorted order are told apart: the usual depth, shallower ones for entries alone there, deeper ones for crowds.
DEPTH, SHALLOWER, DEEPER = 4, (3, 2), (6, 8)
#: A shallower run of at most so many entries is a region; of a larger one only the lonely entries are compared with all others.
SHALLOW = 64
#: A region of at most so many shingles (4 MiB), or of so few entries, is compared whole in one group; a larger one is first entered deeper,
#: and what is then still open is compared in tiles of that size.
REGION, FEW = 1_000_000, 16

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a whole text.

    Words are runs between ASCII white space after lower-casing A-Z. With fewer words than a shingle has, the
    whole sequence is one shingle; without words the set is empty.
    """
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(p) for p in parts), np.uint64, len(parts))
    size = min(words, len(parts))
    with np.errstate(over="ignore"):
        out = np.full(len(parts) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mixed((out + _MIX) ^ hashes[k : len(hashes) - size + 1 + k])
    return np.unique(out)


_RANDOM = np.random.default_rng(20240607)
_FACTORS = _RANDOM.integers(1 << 62, (1 << 63) - 1, VALUES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, (1 << 63) - 1, VALUES, dtype=np.int64).astype(np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``VALUES`` MinHash values, the upper 32 bits of a multiply-and-add hash of each shingle."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            hashed = ((part[None, :] * _FACTORS[:, None] + _TERMS[:, None]) >> np.uint64(32)).astype(np.uint32)
            np.minimum(out, hashed.min(axis=1), out=out)
    return out


#: For each order the values of its label: four of its own, then others.
_PLACES = np.array([[*(own := range(DEPTH * n, DEPTH * n + DEPTH)), *_RANDOM.permutation(np.setdiff1d(np.arange(VALUES), own))[: LABEL - DEPTH]] for n in range(ORDERS)])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, signatures = [], [], []
        for text in batch.column(1):
            shingles = shingle_hashes(text.as_py())
            sizes.append(len(shingles))
            nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            signatures.append(signature(shingles).astype(">u4").tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
            names=["entry_id", "n_shingles", "node", "signature"],
        )


def _node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_hashes(t.as_py()) for t in batch.column(0)]
        nodes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, set of a, set of b) with 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            small, large = min(len(x), len(y)), max(len(x), len(y))
            shared = len(np.intersect1d(x, y, assume_unique=True)) if 100 * small >= 75 * large else 0
            keep.append(bool(shared) and 100 * shared >= 75 * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per order: the leading values by which the entry is sorted there."""
    for batch in batches:
        values = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), ">u4").reshape(batch.num_rows, VALUES)
        labels = values[:, _PLACES].reshape(-1, LABEL)
        row = np.repeat(np.arange(batch.num_rows), ORDERS)
        data = pa.py_buffer(labels.tobytes())
        ends = pa.py_buffer(np.arange(0, 4 * LABEL * (len(labels) + 1), 4 * LABEL, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), batch.num_rows)), pa.BinaryArray.from_buffers(pa.binary(), len(labels), [None, ends, data]),
             batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row))],
            names=["order", "label", "node", "n"],
        )


_RUNS = [min(SHALLOWER), *sorted(SHALLOWER)[1:], DEPTH, *DEEPER]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of one sorted stretch that have a neighbour with a common prefix of two values or more, with the run they are in at each depth.

    A run is all that share so many leading values, so its name is a hash of the order and of these. The first and last entry of a
    stretch may have their neighbour in the next one, so they are kept whatever they are.
    """
    last = None

    def named(order: np.ndarray, values: np.ndarray, node: pa.Array, n: pa.Array, keep: np.ndarray) -> pa.RecordBatch:
        order, values, at = order[keep], values[keep], pa.array(np.flatnonzero(keep))
        names = []
        with np.errstate(over="ignore"):
            for depth in _RUNS:
                key = _mixed(order.astype(np.uint64) * _MIX + np.uint64(depth))
                for k in range(depth):
                    key = _mixed((key + _MIX) ^ values[:, k])
                names.append(pa.array(key.view(np.int64)))
        return pa.RecordBatch.from_arrays([node.take(at), n.take(at), *names], names=["node", "n", *(f"run_{d}" for d in _RUNS)])

    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        order = np.array(batch.column(0))
        values = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), ">u4").astype(np.uint64).reshape(batch.num_rows, LABEL)
        near = (order[1:] == order[:-1]) & (values[1:, : _RUNS[0]] == values[:-1, : _RUNS[0]]).all(axis=1)
        keep = np.append(near, False)
        keep[1:] |= near
        # The last row waits for the next batch, where its own neighbour before it is not seen again.
        keep[0] |= last is None or carried
        carried, last = bool(keep[-1]) and len(keep) > 1, batch.slice(batch.num_rows - 1)
        keep[-1] = False
        yield named(order, values, batch.column(2), batch.column(3), keep)
    if last is not None:
        values = np.frombuffer(last.column(1)[0].as_py(), ">u4").astype(np.uint64).reshape(1, LABEL)
        yield named(np.array(last.column(0)), values, last.column(2), last.column(3), np.ones(1, bool))


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique((np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(32)).astype("<u4")).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _short(sets: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in sets]


def _candidates(xs: list[np.ndarray], x_parts: list, ys: list[np.ndarray], y_parts: list) -> Iterator[tuple[int, int]]:
    """Candidate links (x, y) between different components, by counting each x against all y through the shingles that they share.

    The sets hold the upper 32 bits of each hash, so a pair is a candidate from 0.74 on; components are taken as joined from 0.76
    on, which is beyond any doubt of the shorter hashes, and only pairs between components not yet joined are given.
    """
    sizes = np.array([len(y) for y in ys])
    names, code = np.unique(np.concatenate(ys), return_inverse=True)
    posting = np.repeat(np.arange(len(ys)), sizes)[np.argsort(code, kind="stable")]
    per_code = np.bincount(code, minlength=len(names))
    first = np.cumsum(per_code) - per_code
    numbers = {part: n for n, part in enumerate(dict.fromkeys([*x_parts, *y_parts]))}
    x_numbers, y_numbers = ([numbers[p] for p in parts] for parts in (x_parts, y_parts))
    y_array, joined = np.array(y_numbers), {}

    def root(part: int) -> int:
        while part in joined:
            part = joined[part]
        return part

    for n, x in enumerate(xs):
        codes = np.minimum(np.searchsorted(names, x), len(names) - 1)
        codes = codes[names[codes] == x]
        runs = per_code[codes]
        at = np.repeat(first[codes] - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
        shared = np.bincount(posting[at], minlength=len(ys))
        union = sizes + len(x) - shared
        near = np.flatnonzero((100 * shared >= 74 * union) & (y_array != x_numbers[n]))
        for m in near[np.argsort(-shared[near] / union[near], kind="stable")].tolist():
            mine, other = root(x_numbers[n]), root(y_numbers[m])
            if mine != other:
                yield n, m
                if 100 * shared[m] >= 76 * union[m]:
                    joined[max(mine, other)] = min(mine, other)


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([min(p) for p in found], pa.binary()), "b": pa.array([max(p) for p in found], pa.binary())})


def _open_links(table: pa.Table) -> pa.Table:
    """Candidate links of one region: every member outside the most frequent component against all."""
    nodes, parts, sets = table.column("node").to_pylist(), table.column("component").to_pylist(), _short(table.column("shingles"))
    main = Counter(parts).most_common(1)[0][0]
    xs = [n for n, part in enumerate(parts) if part != main]
    found = _candidates([sets[n] for n in xs], [parts[n] for n in xs], sets, parts)
    return _pairs([(nodes[xs[x]], nodes[y]) for x, y in found])


def _tile_links(table: pa.Table) -> pa.Table:
    """Candidate links of one tile of a region: its members outside the largest component against those of one share."""
    side = table.column("is_x").to_pylist()
    nodes, parts, sets = table.column("node").to_pylist(), table.column("component").to_pylist(), _short(table.column("shingles"))
    xs, ys = ([n for n, x in enumerate(side) if x == wanted] for wanted in (True, False))
    if not xs or not ys:
        return _pairs([])
    found = _candidates([sets[n] for n in xs], [parts[n] for n in xs], [sets[n] for n in ys], [parts[n] for n in ys])
    return _pairs([(nodes[xs[x]], nodes[ys[y]]) for x, y in found])


def _share(shingles: Column) -> Column:
    """Shares of half a region's bound that so many shingles make."""
    return F.ceil(F.greatest(shingles, F.lit(1)) * 2 / F.lit(REGION)).cast("int")


class _Forest:
    """Components of nodes (distinct shingle sets), grown from the runs of the sorted orders."""

    def __init__(self, classes: DataFrame, entries: DataFrame, scratch: Scratch):
        self._classes, self._entries, self._scratch = classes, entries, scratch
        self.links: DataFrame | None = None  # id, component
        self._all_sets: DataFrame | None = None
        self._large: DataFrame | None = None  # region, node, n, alone: shallower runs that are no region

    def grow(self) -> DataFrame | None:
        labels = self._classes.select("node", "signature", "n_shingles").mapInArrow(_labels, "order int, label binary, node binary, n long")
        ranged = labels.repartitionByRange("order", "label", "node").sortWithinPartitions("order", "label", "node")
        runs = ", ".join(f"run_{d} long" for d in _RUNS)
        placed = self._scratch.freeze(ranged.mapInArrow(_neighbours, f"node binary, n long, {runs}"))
        deeper = [f"run_{d}" for d in DEEPER]
        regions = placed.select(F.col(f"run_{DEPTH}").alias("region"), "node", "n", *deeper)
        # An entry that is alone at the usual depth looks for neighbours at shallower ones; where these are many, they do not look for each other.
        lonely, above, large = placed, f"run_{DEPTH}", []
        for depth in SHALLOWER:
            run = f"run_{depth}"
            rest = [F.any_value(f"run_{d}").alias(f"run_{d}") for d in SHALLOWER if d <= depth]
            lonely = lonely.groupBy(above).agg(F.count(F.lit(1)).alias("members"), F.any_value("node").alias("node"), *rest).where("members = 1")
            sizes = placed.groupBy(run).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
            wanted = sizes.join(lonely.select(run).distinct(), run, "left_semi")
            few = wanted.where(F.col("members") <= SHALLOW).select(run)
            regions = regions.unionByName(placed.join(few, run).select(F.col(run).alias("region"), "node", "n", *deeper))
            many = wanted.where(F.col("members") > SHALLOW).select(run)
            alone = lonely.join(many, run, "left_semi").select(F.col(run).alias("region"), "node", F.lit(True).alias("alone"))
            members = placed.join(many, run).select(F.col(run).alias("region"), "node", "n").join(alone, ["region", "node"], "left")
            large.append(members.withColumn("alone", F.coalesce("alone", F.lit(False))))
            above = run
        self._large = self._scratch.freeze(reduce(DataFrame.unionByName, large))
        crowded = self._scratch.freeze(self._visit(regions, deeper))
        level = crowded
        for run in deeper:
            if level.isEmpty():
                break
            rest = deeper[deeper.index(run) + 1 :]
            level = self._scratch.freeze(self._visit(level.select(F.col(run).alias("region"), "node", "n", *rest).distinct(), rest))
        if not crowded.isEmpty():
            self._tiles(crowded)
        if not self._large.isEmpty():
            self._lonely_tiles()
        return self.links

    def _visit(self, regions: DataFrame, deeper: list[str]) -> DataFrame:
        """Join what the regions hold: first every member with the smallest of its region, then open regions counted out. Returns crowded ones."""
        sized = regions.groupBy("region").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
        leaders = self._scratch.freeze(sized)
        crowd = self._scratch.freeze(dealt_join(regions, leaders, "region", "members", leaders.agg(F.sum("members")).first()[0] or 0))
        if self._all_sets is None:
            self._keep_sets(crowd.select("node").unionByName(self._large.select("node")))
        self._extend(crowd.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        labelled = self._labelled(crowd.select("region", "node", "n", *deeper))
        sizes = labelled.groupBy("region").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members"),
            F.bit_xor(F.xxhash64("node")).alias("mark"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("mark_2"))
        is_small = (F.col("shingles") <= REGION) | (F.col("members") <= FEW)
        # Regions of several orders often have the same members: one of them speaks for all.
        once = sizes.where("low <> high").groupBy("members", "mark", "mark_2").agg(F.min("region").alias("region"), F.first(is_small).alias("is_small"))
        opened = self._scratch.freeze(labelled.join(once.select("region", "is_small"), "region"))
        small = opened.where("is_small").select("region", "node", "component")
        with_sets = small.join(self._short_sets(small).hint("merge"), "node")
        self._extend(with_sets.groupBy("region").applyInArrow(_open_links, "a binary, b binary"))
        return opened.where("not is_small").select("region", "node", "n", *deeper)

    def _tiles(self, crowded: DataFrame) -> None:
        """Crowded regions that are still open, exactly: members outside the largest component against all, in tiles of bounded size."""
        labelled = self._labelled(crowded.select("region", "node", "n"))
        counted = labelled.groupBy("region", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
        facts = counted.groupBy("region").agg(
            F.max_by("component", F.struct("members", "component")).alias("main"), F.max_by("n", F.struct("members", "component")).alias("main_n"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("parts"))
        facts = facts.where("parts > 1").select("region", "main", _share(F.col("n_all")).alias("ys"), _share(F.col("n_all") - F.col("main_n")).alias("xs"))
        self._tiled(labelled.join(facts, "region").withColumn("is_x", F.col("component") != F.col("main")))

    def _lonely_tiles(self) -> None:
        """Shallower runs that are too large for regions: their lonely entries against all, in the same tiles."""
        labelled = self._labelled(self._large)
        of_lonely = F.coalesce(F.sum(F.when(F.col("alone"), F.col("n"))), F.lit(0))
        facts = labelled.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), _share(F.sum("n")).alias("ys"), _share(of_lonely).alias("xs"))
        self._tiled(labelled.join(facts.where("low <> high").select("region", "ys", "xs"), "region").withColumnRenamed("alone", "is_x"))

    def _tiled(self, rows: DataFrame) -> None:
        """Links between the members marked ``is_x`` of a region, in ``xs`` shares, and all of it, in ``ys`` shares."""
        rows = self._scratch.freeze(rows)
        part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        ys = rows.select("region", "node", "component", F.lit(False).alias("is_x"), part("ys").alias("y"), every("xs").alias("x"))
        xs = rows.where("is_x").select("region", "node", "component", "is_x", part("xs").alias("x"), every("ys").alias("y"))
        tiles = ys.unionByName(xs).join(self._short_sets(rows).hint("merge"), "node")
        self._extend(tiles.groupBy("region", "x", "y").applyInArrow(_tile_links, "a binary, b binary"))

    def _keep_sets(self, nodes: DataFrame) -> None:
        """Store (node, shingles) of all nodes that have a neighbour, from one text of each: later visits see no others."""
        ids = self._classes.join(nodes.distinct().hint("merge"), "node", "left_semi").select(F.col("first_id").alias("entry_id")).distinct()
        # Neither side is of bounded size, so neither is broadcast: the plan is the same at every size.
        texts = self._entries.join(ids.hint("merge"), "entry_id", "left_semi").select("exact_text")
        self._all_sets = self._scratch.freeze(texts.mapInArrow(_node_sets, "node binary, shingles binary"))

    def _short_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles): of each hash the upper 32 bits, which is enough to find candidates."""
        return self._all_sets.join(nodes.select("node").distinct().hint("merge"), "node", "left_semi").mapInArrow(_shortened, "node binary, shingles binary")

    def _labelled(self, rows: DataFrame) -> DataFrame:
        if self.links is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(self.links.withColumnRenamed("id", "node").hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def _extend(self, pairs: DataFrame) -> None:
        """Add those of the candidate pairs between different components that their full sets confirm."""
        pairs = pairs.distinct()
        if self.links is not None:
            for end in ("a", "b"):
                pairs = pairs.join(self.links.select(F.col("id").alias(end), F.col("component").alias(f"part_{end}")).hint("merge"), end, "left")
            pairs = pairs.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
        pairs = self._scratch.freeze(pairs)
        sets = self._all_sets
        with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")).hint("merge"), "b")
        # One node may lead a large region: its set meets its pairs under salts.
        led = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")).hint("merge"), "a")
        both = dealt_join(with_b, led, "a", "pairs", pairs.count())
        new = self._scratch.freeze(both.select("a", "b", "set_a", "set_b").mapInArrow(_linked, "a binary, b binary"))
        if new.isEmpty():
            return
        if self.links is not None:
            new = new.unionByName(self.links.select(F.col("component").alias("a"), F.col("id").alias("b")))
        self.links = components(new, self._scratch)


def near_duplicates(entries: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """Per entry: ``entry_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    ``entry_id`` may have any type with an order. Two entries are linked when their sets of distinct five-word shingles have a similarity of
    0.75 or more (100 * intersection >= 75 * union, confirmed on the full sets of 64-bit shingle hashes). Entries with equal sets are one
    node from the start, so copies cost one row.

    The forest sorts the nodes in 24 orders, each by eight leading values of a signature of 96, in ranges over all tasks. Neighbours in an order are
    candidates by their longest common prefix. A region is a run with a common prefix of four values; a node that is alone there goes to
    a prefix of three, then two, and where such a run is large, it alone is compared with the others; a crowded region is entered again at six and eight values. In a region every
    member is first paired with its smallest one, and confirmed pairs are joined into components. A region of one component is finished,
    however many nodes it holds. Open ones are counted out exactly, each member outside the largest component against all: whole if
    the sets fit in 4 MiB (or they are few), and else, after the deeper runs have joined what they can, in tiles of that size. So every pair that
    shares four values in some order is compared or lies in one component; a pair at similarity 0.75 shares none with probability 1.1e-4,
    less above. Work in crowded regions grows with the square of their open part.

    Defined cases: null and empty texts have 0 shingles, link with nothing and stay; repeated rows of an id get the result
    of the id, and an id with several texts is linked by each of them; a null id links with nothing, has a null component and stays; an empty
    table gives an empty table. Other columns are not read. The result is stored once; ``scratch`` owns it, without one it stays in the shared folder.
    """
    spark, id_type = entries.sparkSession, entries.schema["entry_id"].dataType.simpleString()
    rows, owner = entries.select("entry_id", "exact_text"), scratch or Scratch(spark)
    with Scratch(spark) as inner:
        sketched = inner.freeze(rows.mapInArrow(_sketches, f"entry_id {id_type}, n_shingles long, node binary, signature binary"))
        named = sketched.where("entry_id is not null and node is not null")
        classes = inner.freeze(named.groupBy("node").agg(
            F.min("entry_id").alias("first_id"), F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies")))
        forest = _Forest(classes, rows, inner)
        labels = forest.grow()
        twice = inner.freeze(named.groupBy("entry_id").agg(F.min("node").alias("a"), F.max("node").alias("other")).where("a <> other").select("entry_id", "a"))
        if not twice.isEmpty():
            same = named.join(twice, "entry_id").select("a", F.col("node").alias("b"))
            labels = components(same if labels is None else same.unionByName(labels.select(F.col("component").alias("a"), F.col("id").alias("b"))), inner)
        if labels is None:
            labels = spark.createDataFrame([], "id binary, component binary")
        joined = classes.join(labels.withColumnRenamed("id", "node").hint("merge"), "node", "left").select("node", "first_id", "copies", F.coalesce("component", "node").alias("component"))
        joined = inner.freeze(joined)
        first = joined.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
        of_node = inner.freeze(dealt_join(joined, first, "component", "nodes", joined.count()).select("node", "component_id", "copies"))
        alone = sketched.where("entry_id is null or node is null").select("entry_id", "n_shingles", F.col("entry_id").alias("component_id"))
        found = dealt_join(named.select("entry_id", "n_shingles", "node"), of_node, "node", "copies", sketched.count())
        result = found.select("entry_id", "n_shingles", "component_id").unionByName(alone)
        stored = owner.freeze(result.withColumn("kept", F.col("entry_id").eqNullSafe(F.col("component_id"))))
    return stored
