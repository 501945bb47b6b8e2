"""Table digests that never gather a table in one task.

Multiset digest: equal hashes are counted first (map-side), so any number of exact
copies is one entry. Entries are then folded up a fixed radix tree over the hash
prefix: 5 hex characters, 2, none. SHA-256 spreads distinct hashes evenly, so a leaf
holds about N / 1.05 million entries and every inner node at most 4,096 children.

Order digest: hashes are folded in blocks of 65,536 consecutive positions, three
times, which covers 2.8e14 rows with at most 65,536 entries per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import freeze

LEAF_PREFIX = 5
HASH_BYTES = 32
INNER_PREFIX = 2
BLOCK = 65_536
BLOCK_LEVELS = 3
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def _fold(parts: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), ","), 256)


def packed_run(hash_bytes: Column, copies: Column) -> Column:
    """A hash and a count as bytes, which take half the room of their text while they are shuffled."""
    return F.concat(hash_bytes, copies.cast("string").cast("binary"))


def run_text(packed: Column, joint: str) -> Column:
    """The text of a packed run: hexadecimal hash, joint and count."""
    return F.concat(F.lower(F.hex(F.substr(packed, F.lit(1), F.lit(HASH_BYTES)))), F.lit(joint), F.substr(packed, F.lit(HASH_BYTES + 1)).cast("string"))


def hash_text(hash_bytes: Column) -> Column:
    return F.lower(F.hex(hash_bytes))


def multiset_digest(hashes: DataFrame, column: str = "record_sha256", copies: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (row_count, distinct_count, records_sha256), whatever the row order; one per value of ``by`` if that is given.

    ``copies`` names the count of already distinct hashes, which saves the counting shuffle. Hashes may be text or bytes.
    """
    if copies:
        counted = hashes.select(*by, F.col(column).alias("_h"), F.col(copies).alias("_n"))
    else:
        counted = hashes.groupBy(*by, F.col(column).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(hashes.schema[column].dataType, T.BinaryType):
        prefix = F.substring(F.lower(F.hex(F.substring("_h", 1, (LEAF_PREFIX + 1) // 2))), 1, LEAF_PREFIX)
        runs = F.transform(F.sort_array(F.collect_list(packed_run(F.col("_h"), F.col("_n")))), lambda r: run_text(r, ":"))
        folded = F.sha2(F.array_join(runs, ","), 256)
    else:
        prefix, folded = F.substring("_h", 1, LEAF_PREFIX), _fold(F.concat_ws(":", "_h", F.col("_n").cast("string")))
    leaf = counted.groupBy(*by, prefix.alias("_p")).agg(
        folded.alias("_d"),
        F.sum("_n").alias("_rows"),
        F.count(F.lit(1)).alias("_distinct"),
    )
    inner = leaf.groupBy(*by, F.substring("_p", 1, INNER_PREFIX).alias("_q")).agg(
        _fold(F.concat_ws("=", "_p", "_d")).alias("_d"),
        F.sum("_rows").alias("_rows"),
        F.sum("_distinct").alias("_distinct"),
    )
    return inner.groupBy(*by).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("_distinct"), F.lit(0)).alias("distinct_count"),
        _fold(F.concat_ws("=", "_q", "_d")).alias("records_sha256"),
    )


def order_digest(
    positioned: DataFrame, ordinal: str = "ordinal", column: str = "record_sha256", by: tuple[str, ...] = (), shown: Callable[[Column], Column] | None = None, levels: int = BLOCK_LEVELS
) -> DataFrame:
    """One row (order_sha256) over hashes in the order of a unique 0-based ordinal; one per value of ``by`` if that is given.

    ``shown`` turns the column into its text, once the rows have been shuffled; ``levels`` is less for rows that are digests of blocks. A repeated ordinal is refused; with ``by`` the digest of its table says so instead, so that the others are still told.
    """
    refused = F.lit("ORDINAL_NOT_UNIQUE") if by else F.raise_error(F.lit("ORDINAL_NOT_UNIQUE"))
    level = positioned.select(*by, F.col(ordinal).cast("long").alias("_i"), F.col(column).alias("_d"))
    for depth in range(levels):
        text = F.transform(F.col("_e._d"), shown) if shown and depth == 0 else F.col("_e._d")
        entries = F.sort_array(F.collect_list(F.struct("_i", "_d")))
        level = (
            level.groupBy(*by, F.expr(f"_i div {BLOCK}").alias("_b"))
            .agg(entries.alias("_e"))
            .select(
                *by,
                F.col("_b").alias("_i"),
                F.when(F.size(F.array_distinct(F.col("_e._i"))) != F.size("_e"), refused)
                .when(F.array_contains(text, "ORDINAL_NOT_UNIQUE"), F.lit("ORDINAL_NOT_UNIQUE"))
                .otherwise(F.sha2(F.array_join(text, ","), 256))
                .alias("_d"),
            )
        )
    return level.groupBy(*by).agg(F.coalesce(F.max("_d"), F.lit(EMPTY)).alias("order_sha256"))


def with_positions(frame: DataFrame, order: list[Column], name: str = "position", step: str | None = None, store: Callable[[DataFrame], DataFrame] = freeze, ranged: bool = False) -> DataFrame:
    """0-based position of every row in a total order, without a single-task window.

    The rows are range-partitioned and sorted once and stored; the only global step
    is a running total over one row per partition. ``step`` names a column with how
    many positions a row takes (for run-length encoded rows). ``store`` writes the sorted
    rows; a caller that wants them removed afterwards gives that of its scratch. ``ranged`` says that the frame is in ranges of the order already.
    """
    ordered = (frame if ranged else frame.repartitionByRange(*order)).sortWithinPartitions(*order)
    stored = store(ordered.withColumn("_mid", F.monotonically_increasing_id()))
    slot = F.shiftright("_mid", 33)
    width = F.col(step) if step else F.lit(1)
    per_slot = stored.groupBy(slot.alias("_slot")).agg(F.sum(width).alias("_width"))
    # one row per partition: bounded by the partition count, not by the data
    running = F.expr("sum(_width) over (order by _slot rows between unbounded preceding and current row)")
    offsets = per_slot.select("_slot", (running - F.col("_width")).alias("_offset"))
    tagged = stored.withColumn("_slot", slot)
    if step:
        inside = F.expr(
            f"sum({step}) over (partition by _slot order by _mid rows between unbounded preceding and current row)"
        ) - F.col(step)
    else:
        inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_slot")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_slot", "_offset", "_inside", "_mid")
    )
