"""Evidence of many sources mixed to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.digest import with_positions
from plumbline.session import Scratch

#: Hexadecimal digits of the shuffle hash that deal one source's queue over tasks: 4,096 parts of any source.
DEAL = 3


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key(locator: Column) -> Column:
    """A key that is never null, so that the shares of a source meet under plain equality."""
    return F.when(locator.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), locator))


def cyclic_weights(evidence: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), *, scratch: Scratch | None = None) -> DataFrame:
    """Rows ``source_locator``, ``weight``: the sources by code point, null last, weigh ``cycle`` over and over."""
    store = scratch or Scratch(evidence.sparkSession)
    sources = evidence.select("source_locator").distinct()
    placed = with_positions(sources, [F.col("source_locator").asc_nulls_last()], "place", store=store.freeze)
    return placed.select("source_locator", F.element_at(F.array(*map(F.lit, cycle)), (F.col("place") % len(cycle) + 1).cast("int")).alias("weight"))


def water_level(sources: DataFrame, budget: int) -> float | None:
    """The share per unit of weight at which ``least(cap, share * weight)`` adds up to ``budget``; None if no source is left below its cap.

    ``sources`` has ``cap`` (long) and ``weight`` (decimal). Each round is one aggregate to one row; a round caps further sources
    at the level of the one before, and the sums are exact, so their order does not matter.
    """
    level, capped = 0.0, -1
    while True:
        full = (F.col("cap") <= F.col("weight").cast("double") * F.lit(level)) | (F.col("weight") == 0)
        now = sources.agg(
            F.sum(F.when(full & (F.col("weight") > 0), F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("rest"), F.count(F.when(full, 1)).alias("n")
        ).first()
        if not now["rest"]:
            return None
        if now["n"] == capped:
            return level
        level, capped = (budget - (now["caps"] or 0)) / float(now["rest"]), now["n"]


def mix_sources(
    evidence: DataFrame,
    weights: DataFrame,
    *,
    budget_percent: int = 150,
    max_repeats: int = 2,
    quantum: int = 256,
    seed: str = ":mix",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per evidence row: ``evidence_id``, ``size``, ``source_size``, ``target``, ``taken``, ``virtual_finish``.

    ``evidence`` has ``evidence_id``, ``source_locator`` and ``extraction``; ``weights`` has one row ``source_locator``, ``weight`` (not
    negative) per source. The mix takes ``budget_percent`` of all words. A source's ``target`` is its share by weight, at most
    ``max_repeats`` times its words, the excess shared by weight among the others until none is above.

    Weighted fair queueing: each source queues its extractions in the order of a hash of their ids, ``max_repeats`` times over. What
    is served at once is at most ``quantum`` words of one extraction; its virtual finish time is the words of its source queued up to its
    end, divided by the source's weight. All servings are range-sorted by finish time (then source, then place in the queue) and
    cut where their running total reaches the budget; the serving at the cut is taken in part. So a source is served to within
    ``quantum`` words of its target, and a source that has run dry leaves its share to the others. ``taken`` counts the words
    of the row that are served, repeats included; ``virtual_finish`` orders the mix (finish time of the first copy, null for weight 0).

    A source of any size is dealt over 4,096 parts by the hash: prefix sums run within a part, and part totals (at most 4,096 rows a
    source) are summed above them; facts of the source meet its parts, never its rows. Only ids, sizes and hashes are shuffled. Of the sorted
    servings only one total per partition is summed globally, and a running total is taken within the one partition that holds the cut.

    Defined cases: a null extraction has no words; rows without words are taken 0 times and stay in the result; a null locator is a source
    like another (its weight is that of the null row in ``weights``); a source without weight has weight 0 and target 0; repeated rows
    queue once each; rows that share id, source and size are interchangeable; an empty table gives an empty table. Other columns are not
    carried. ``scratch`` owns the stored tables; without one they stay in the shared folder.
    """
    store = scratch or Scratch(evidence.sparkSession)
    row = evidence.select(
        F.col("evidence_id"),
        _source_key(F.col("source_locator")).alias("source"),
        word_count(F.col("extraction")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("evidence_id").cast("string"), F.lit("")), F.lit(seed))).alias("turn"),
    )
    row = store.freeze(row.withColumn("part", F.substring("turn", 1, DEAL)))
    part_sizes = row.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    of_source = Window.partitionBy("source")
    parts = part_sizes.select(
        "source", "part",
        (F.sum("part_size").over(of_source.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_size")).alias("part_start"),
        F.sum("part_size").over(of_source).alias("source_size"),
    )
    weighed = weights.select(_source_key(F.col("source_locator")).alias("source"), F.col("weight").cast("decimal(28,9)").alias("weight")).distinct()
    sources = part_sizes.groupBy("source").agg((F.sum("part_size") * max_repeats).alias("cap")).join(weighed.hint("merge"), "source", "left")
    sources = store.freeze(sources.withColumn("weight", F.coalesce("weight", F.lit(0).cast("decimal(28,9)"))))
    budget = (row.agg(F.sum("size")).first()[0] or 0) * budget_percent // 100
    level, weight = water_level(sources, budget), F.col("weight").cast("double")
    share = F.col("cap").cast("double") if level is None else F.when(F.col("cap") <= weight * F.lit(level), F.col("cap").cast("double")).otherwise(weight * F.lit(level))
    targets = sources.select("source", weight.alias("weight"), F.when(F.col("weight") > 0, share).otherwise(F.lit(0.0)).alias("target"))

    queued = Window.partitionBy("source", "part").orderBy("turn", F.col("evidence_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = row.withColumn("inside", F.sum("size").over(queued) - F.col("size"))
    known = parts.join(targets.hint("merge"), "source")
    queue = placed.join(known.hint("merge"), ["source", "part"]).select(
        "evidence_id", "source", "size", "source_size", "weight", "target", (F.col("part_start") + F.col("inside")).alias("start")
    )
    queue = store.freeze(queue)
    cut = _cut(queue, budget, max_repeats, quantum, store)

    def served(copy: int) -> Column:
        start = F.col("source_size") * copy + F.col("start")
        if cut is None:
            return F.when(F.col("weight") > 0, F.col("size")).otherwise(F.lit(0))
        full, at = _before(start + F.col("size"), cut), _before(start + F.least(F.lit(quantum), F.col("size")), cut)
        ends = F.transform(F.sequence(F.lit(1).cast("long"), _servings(quantum)), lambda k: F.least(k * quantum, F.col("size")))
        one_by_one = F.aggregate(
            ends, F.lit(0).cast("long"),
            lambda acc, end: acc + F.when(_before(start + end, cut), (end - 1) % quantum + 1).when(_is_cut(start + end, cut), F.lit(cut["left"])).otherwise(F.lit(0)),
        )
        first_is_out = ~at & ~_is_cut(start + F.least(F.lit(quantum), F.col("size")), cut)
        none = (F.col("size") == 0) | (F.col("weight") == 0)
        return F.when(none, F.lit(0)).when(full, F.col("size")).when(first_is_out, F.lit(0)).otherwise(one_by_one)

    taken = served(0)
    for copy in range(1, max_repeats):
        taken = taken + served(copy)
    finish = F.when(F.col("weight") > 0, (F.col("start") + F.col("size")) / F.col("weight"))
    return queue.select("evidence_id", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("virtual_finish"))


def _servings(quantum: int) -> Column:
    return F.ceil(F.col("size") / quantum).cast("long")


def _before(end: Column, cut: dict) -> Column:
    """Whether the serving that ends there is sorted before the cut."""
    finish = end / F.col("weight")
    earlier = (F.col("source") < cut["source"]) | ((F.col("source") == cut["source"]) & (end < cut["end"]))
    return (finish < cut["finish"]) | ((finish == cut["finish"]) & earlier)


def _is_cut(end: Column, cut: dict) -> Column:
    return (F.col("source") == cut["source"]) & (end == cut["end"])


def _cut(queue: DataFrame, budget: int, max_repeats: int, quantum: int, store: Scratch) -> dict | None:
    """The serving at which the running total reaches the budget, and how many of its words are taken; None if there is room for all."""
    copies = queue.where("size > 0 and weight > 0").select(
        "source", "weight", "size",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.col("source_size") * e + F.col("start"))).alias("start"),
    )
    cut_up = copies.select("source", "weight", "size", "start", F.explode(F.sequence(F.lit(1).cast("long"), _servings(quantum))).alias("k"))
    upto = F.least(F.col("k") * quantum, F.col("size"))
    servings = cut_up.select(
        ((F.col("start") + upto) / F.col("weight")).alias("finish"), "source", (F.col("start") + upto).alias("end"), ((upto - 1) % quantum + 1).alias("words")
    )
    order = ["finish", "source", "end"]
    ranged = servings.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slot", F.spark_partition_id())
    stored = store.freeze(ranged)
    # One row per range partition: bounded by the partition count, not by the data.
    running = F.expr("sum(words) over (order by slot rows between unbounded preceding and current row)")
    totals = stored.groupBy("slot").agg(F.sum("words").alias("words")).select("slot", "words", running.alias("total"))
    slot = totals.where(F.col("total") >= budget).orderBy("slot").first()
    if slot is None or budget <= 0:
        return None if budget > 0 else {"finish": -1.0, "source": "", "end": -1, "left": 0}
    before = slot["total"] - slot["words"]
    inside = Window.partitionBy("slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reached = stored.where(F.col("slot") == slot["slot"]).withColumn("total", F.sum("words").over(inside) + before).where(F.col("total") >= budget)
    at = reached.orderBy(*order).first()
    return {"finish": at["finish"], "source": at["source"], "end": at["end"], "left": at["words"] - (at["total"] - budget)}
