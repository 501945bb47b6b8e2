"""Keyed comparison and preserve-all reconciliation of two versions of a table.

Both sides are counted by (key hash, record hash) in one aggregation, so exact copies
and hot keys shrink before anything is joined. Groups are compared by counts per hash,
never by collected lists. Rows with a missing key part never meet a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.functions.canon import key_hash, record_hash
from plumbline.operators.ordering import resolve_columns
from plumbline.session import freeze


def compatible_keys(left: DataFrame, right: DataFrame, keys) -> tuple[str, ...]:
    """The keys must resolve to the same columns on both sides."""
    if not keys:
        raise Refusal("DATA_RECONCILIATION_KEY_INVALID", "at least one key is required")
    try:
        on_left, on_right = resolve_columns(left, keys), resolve_columns(right, keys)
    except Refusal as refusal:
        raise Refusal("DATA_RECONCILIATION_KEY_INVALID", refusal.message) from refusal
    if on_left != on_right:
        raise Refusal("DATA_RECONCILIATION_KEY_INVALID", "keys differ between the sides")
    return on_left


def _side(frame: DataFrame, keys, ordinal: str, content, side: str) -> DataFrame:
    return frame.select(
        F.lit(side).alias("side"), F.col(f"`{ordinal}`").cast("long").alias("ordinal"),
        key_hash(frame, keys).alias("key_sha256"), record_hash(frame, content).alias("source_record_sha256"),
    )


def hashed_sides(left: DataFrame, right: DataFrame, keys, ordinal: str) -> DataFrame:
    """(side, ordinal, key_sha256, source_record_sha256) of both sides; the ordinal is not content."""
    keys = compatible_keys(left, right, keys)
    content = [c for c in left.columns if c != ordinal or ordinal in keys]
    both = [c for c in right.columns if c != ordinal or ordinal in keys]
    return _side(left, keys, ordinal, content, "LEFT").unionByName(_side(right, keys, ordinal, both, "RIGHT"))


def record_groups(sides: DataFrame) -> DataFrame:
    """Copies per (key, record) on each side."""
    return sides.groupBy("key_sha256", "source_record_sha256").agg(
        F.count_if(F.col("side") == "LEFT").alias("left_copies"),
        F.count_if(F.col("side") == "RIGHT").alias("right_copies"),
    )


def key_groups(groups: DataFrame) -> DataFrame:
    """One row per key with its class and conflict flag; key NULL holds the rows without identity."""
    n_left, n_right = F.col("n_left"), F.col("n_right")
    repeated = (n_left > 1) | (n_right > 1)
    label = (
        F.when(F.col("key_sha256").isNull(), "UNKNOWN")
        .when(repeated, "CANDIDATE_DUPLICATE")
        .when(n_left == 0, "ADDED")
        .when(n_right == 0, "ABSENT")
        .when(F.col("same"), "UNCHANGED")
        .otherwise("MODIFIED")
    )
    conflict = F.col("key_sha256").isNotNull() & (n_left > 0) & (n_right > 0) & ~F.col("same")
    return (
        groups.groupBy("key_sha256")
        .agg(
            F.sum("left_copies").alias("n_left"),
            F.sum("right_copies").alias("n_right"),
            F.bool_and(F.col("left_copies") == F.col("right_copies")).alias("same"),
            F.sum(F.least("left_copies", "right_copies")).alias("exact_matches"),
        )
        .withColumns({"classification": label, "conflict": conflict})
    )


def delta_summary(sides: DataFrame) -> DataFrame:
    """One row of counts. ``unknown_count`` keeps the joint definition (rows without a key
    plus duplicate key groups); its two parts are given as well."""
    keyed = key_groups(record_groups(sides))

    def of(label: str) -> Column:
        return F.count_if(F.col("classification") == label)

    no_key = F.coalesce(
        F.sum(F.when(F.col("key_sha256").isNull(), F.col("n_left") + F.col("n_right"))), F.lit(0))
    return keyed.agg(
        F.coalesce(F.sum("exact_matches"), F.lit(0)).alias("exact_duplicate_count"),
        of("CANDIDATE_DUPLICATE").alias("candidate_duplicate_count"),
        F.count_if("conflict").alias("conflict_count"),
        F.count_if("conflict").alias("preserved_conflict_count"),
        of("ADDED").alias("added_count"), of("ABSENT").alias("absent_count"),
        of("MODIFIED").alias("modified_count"), of("UNCHANGED").alias("unchanged_count"),
        (no_key + of("CANDIDATE_DUPLICATE")).alias("unknown_count"),
        no_key.alias("missing_key_rows"),
        of("CANDIDATE_DUPLICATE").alias("duplicate_key_groups"),
    )


def delta_ledger(sides: DataFrame) -> DataFrame:
    """One entry per input record on each side. A record hash fixes its key, so the
    join back is on the record hash alone; a hot side is split by the adaptive skew join.

    The hashed sides are stored once, their hashes as bytes: they are counted, joined back and listed from there."""
    sides = freeze(sides.withColumns({n: F.unhex(n) for n in ("key_sha256", "source_record_sha256")}))
    groups = record_groups(sides.filter("key_sha256 is not null"))
    labelled = groups.join(
        key_groups(groups).select("key_sha256", "n_left", "n_right", "classification", "conflict"), "key_sha256"
    ).drop("key_sha256")
    keyed = sides.filter("key_sha256 is not null").join(labelled, "source_record_sha256")
    on_left = F.col("side") == "LEFT"
    entries = keyed.select(
        "side", "ordinal", "source_record_sha256", "key_sha256", "classification",
        F.when(on_left, F.col("n_right")).otherwise(F.col("n_left")).alias("counterpart_count"),
        F.when(on_left, F.col("right_copies")).otherwise(F.col("left_copies")).alias("exact_counterpart_count"),
        "conflict", F.lit(True).alias("preserved"),
    )
    unknown = sides.filter("key_sha256 is null").select(
        "side", "ordinal", "source_record_sha256", "key_sha256", F.lit("UNKNOWN").alias("classification"),
        F.lit(0).cast("long").alias("counterpart_count"), F.lit(0).cast("long").alias("exact_counterpart_count"),
        F.lit(False).alias("conflict"), F.lit(True).alias("preserved"),
    )
    return entries.unionByName(unknown).withColumns({n: F.lower(F.hex(n)) for n in ("key_sha256", "source_record_sha256")})


def reconcile(left: DataFrame, right: DataFrame, keys, ordinal: str) -> DataFrame:
    """Preserve-all union: left rows, then right rows, columns united by name, side kept.

    The combined order is (side, ordinal): no row is dropped, merged or chosen.
    """
    compatible_keys(left, right, keys)
    first = left.withColumns({"side": F.lit("LEFT"), "side_order": F.lit(0)})
    second = right.withColumns({"side": F.lit("RIGHT"), "side_order": F.lit(1)})
    return first.unionByName(second, allowMissingColumns=True)


def exact_matches(left_hashes: DataFrame, right_hashes: DataFrame) -> DataFrame:
    """Size of the multiset intersection of two hash columns, from counts only."""
    both = left_hashes.select(F.col(left_hashes.columns[0]).alias("h"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right_hashes.select(F.col(right_hashes.columns[0]).alias("h"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy("h").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per.agg(F.coalesce(F.sum(F.least("l", "r")), F.lit(0)).alias("exact_matches"))


def changed_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids whose row differs or that are on one side only (ids are unique per side)."""
    a = left.select(F.col(key), record_hash(left).alias("_l"))
    b = right.select(F.col(key), record_hash(right).alias("_r"))
    change = F.when(F.col("_l").isNull(), "ADDED").when(F.col("_r").isNull(), "REMOVED").otherwise("CHANGED")
    return (
        a.join(b, key, "full_outer").filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(key, change.alias("change"))
    )


def id_sets(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Distinct ids of both sides labelled BOTH, EXPECTED_ONLY or OBSERVED_ONLY."""
    tagged = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(
        observed.select(key, F.lit(0).alias("e"), F.lit(1).alias("o")))
    per = tagged.groupBy(key).agg(F.max("e").alias("e"), F.max("o").alias("o"))
    place = F.when((F.col("e") == 1) & (F.col("o") == 1), "BOTH").when(F.col("e") == 1, "EXPECTED_ONLY").otherwise("OBSERVED_ONLY")
    return per.select(key, place.alias("membership"))
