"""Connected components of links between ids, as iterated joins, and joins that deal hot keys over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import Scratch

#: A key is hot with more rows than this, and than a ten-thousandth of all rows: so no more than 10,000 keys are hot.
HOT_ROWS, HOT_KEYS, SALTS = 1_000, 10_000, 16


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the one row of ``facts`` per ``key``; ``size`` is a column of facts that counts the rows of the key, ``total`` all rows.

    Rows of a hot key are dealt over salts, and its facts repeated for each. The hot keys, at most ``HOT_KEYS`` by their definition,
    are sent to all tasks; nothing else is. ``size`` is not in the result.
    """
    is_hot = F.col(size) > max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(facts.where(is_hot).select(key, F.lit(True).alias("__hot")))
    some = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), some).otherwise(0)).drop("__hot")
    shares = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(facts.withColumn("__salt", shares).drop(size).hint("merge"), [key, "__salt"]).drop("__salt")


def components(links: DataFrame, store: Scratch) -> DataFrame:
    """Rows ``id``, ``component`` (smallest id reachable) for every id of ``links`` (columns ``a``, ``b`` of any ordered type).

    Alternates two steps until nothing changes: every id points its larger neighbours at its smallest
    neighbour, then every id points its smaller neighbours there. Both keep connectivity, at most one row per
    link is written, and a star of any size stays a star, so a component of a third of all ids takes a few
    rounds. The minimum of a neighbourhood is a partial aggregate; it meets the links of its id again under salts, so
    the centre of a large star is not one task. Each round is written to the shared folder and the one before removed; nothing
    is collected. ``store`` owns the result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    scratch, mark = Scratch(links.sparkSession), None
    edges = scratch.freeze(edges)
    while True:
        total = 2 * edges.count()
        # Large star: the larger neighbours of u, and u itself, point at the minimum around u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = dealt_join(both, low, "u", "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours point at the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = dealt_join(large, low, "u", "n", total).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = Scratch(links.sparkSession)
        new = after.freeze(small)
        # The rows are sets, so equal count and equal sum of row hashes mean that nothing has changed.
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.close()
        edges, scratch = new, after
        if now == mark:
            break
        mark = now
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = store.freeze(ends.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())
    scratch.close()
    return found
