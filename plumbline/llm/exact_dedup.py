"""Exact duplicates of verbatim entries, combined locally, under a salt and then globally."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import Scratch

#: Salts of the middle combine: no digest group is larger in one task than its local winners divided by this.
SALTS = 16
#: A class is hot with more rows than this, and than a ten-thousandth of all: so no more than 10,000 classes are hot.
HOT_ROWS, HOT_CLASSES = 1_000, 10_000


def normal_text(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _combine(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(entries: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """Per entry: ``entry_id``, ``keep_id``, ``group_size``, ``kept``, ``exact_text_sha256``.

    Entries are equal when their texts are identical after lower-casing A-Z; the largest ``entry_id`` stays.

    Three combines, each keyed by the digest *and* the whole text, so that equal digests alone never
    merge two texts: every input partition first folds its own copies (the partial side of the aggregation),
    then folded rows meet under (digest, salt), where a third of all rows being one text is at most one row per
    input partition dealt over ``salts`` groups, then the salt winners meet. Entries find their class by digest, those of a hot class
    (at most 10,000 classes are, whose digests are sent to all tasks) under a salt; only a
    digest that stands for several texts (looked up, not assumed away) is joined by text as well.

    Defined cases: a null text is an empty one; repeated rows of one id count each and get the same
    result; a null id never stays while its group has an id (``keep_id`` is null, and ``kept`` true, only if all
    ids of the group are null); an empty table gives an empty table. Other columns are not carried.
    """
    text = normal_text(F.col("exact_text"))
    rows = entries.select(F.col("entry_id").alias("entry_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    single = rows.select("digest", "text", F.col("entry_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    salted = _combine(single.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))), "digest", "salt")
    classes = _combine(salted, "digest")
    result = lambda frame: frame.select(
        "entry_id", "keep_id", "group_size", F.col("entry_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("exact_text_sha256")
    )
    with Scratch(entries.sparkSession) as scratch:
        # One row per digest without its text: 56 bytes a class.
        by_digest = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
        by_digest = scratch.freeze(by_digest)
        collide = by_digest.where("texts > 1").select("digest")
        total = by_digest.agg(F.sum("group_size")).first()[0] or 0
        is_hot = F.col("group_size") > max(HOT_ROWS, total // HOT_CLASSES)
        hot = F.broadcast(by_digest.where(is_hot).select("digest", F.lit(True).alias("hot")))  # at most HOT_CLASSES digests
        dealt = rows.select("entry_id", "digest").join(hot, "digest", "left")
        dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("entry_id"), F.lit(salts)).cast("int")).otherwise(0))
        shares = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
        plain = dealt.join(by_digest.where("texts = 1").withColumn("salt", shares).hint("merge"), ["digest", "salt"])
        if collide.isEmpty():
            scratch.keep()
            return result(plain)
        exact = rows.join(collide, "digest", "left_semi").join(classes.join(collide, "digest", "left_semi"), ["digest", "text"])
        scratch.keep()
        return result(plain).unionByName(result(exact))
