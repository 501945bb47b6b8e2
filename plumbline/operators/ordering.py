"""Declared sort specification and the deterministic total order it gives."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import Refusal
from plumbline.functions.canon import is_missing, json_value, record_hash
from plumbline.operators.digest import BLOCK, BLOCK_LEVELS, HASH_BYTES, order_digest, packed_run, run_text, with_positions
from plumbline.session import tasks_for

# The accepted policies of a sort specification.
NULL_ORDERINGS = ("nulls_first", "nulls_last", "nulls_error")
DUPLICATE_POLICIES = ("block", "exact")
IDENTITY_RULE = "identity_no_coercion"


@dataclass(frozen=True)
class SortSpec:
    keys: tuple[str, ...]
    tie_break: tuple[str, ...] = ()
    nulls: str = "nulls_last"
    duplicate_policy: str = "block"
    normalization: tuple[str, ...] = (IDENTITY_RULE,)
    exclusions: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    source_records_sha256: str | None = None
    source_order_sha256: str | None = None
    parent_ids: tuple[str, ...] = ()
    plan_path: str | None = None
    plan_sha256: str | None = None
    snapshot_id: str | None = None
    manifest_sha256: str | None = None
    operation_sha256: str | None = None
    sources: tuple[str, ...] = ()
    versions: dict[str, str] = field(default_factory=lambda: {"policy": "2", "normalizer": "1"})


def make_sort_spec(frame: DataFrame, keys, tie_break=(), nulls="nulls_last", duplicate_policy="block",
                   normalization=(), exclusions=(), **bindings) -> SortSpec:
    """Validate a declaration; anything that would guess, drop or coerce is refused."""
    if nulls not in NULL_ORDERINGS:
        raise Refusal("READINESS_INVALID_NULLS", f"unknown null order {nulls}")
    if duplicate_policy not in DUPLICATE_POLICIES:
        raise Refusal("READINESS_INVALID_DUPLICATES", "readiness never deletes duplicate records")
    if not keys:
        raise Refusal("READINESS_AMBIGUOUS_IDENTITY", "no primary key was declared")
    if tuple(normalization) not in ((), (IDENTITY_RULE,)):
        raise Refusal("READINESS_UNSUPPORTED_NORMALIZATION", "values are never silently transformed")
    if exclusions:
        raise Refusal("READINESS_UNSUPPORTED_EXCLUSION", "records are never silently excluded")
    keys, tie_break = resolve_columns(frame, keys), resolve_columns(frame, tie_break)
    if set(keys) & set(tie_break):
        raise Refusal("READINESS_DUPLICATE_COLUMN", "primary and tie-break columns overlap")
    return SortSpec(keys, tie_break, nulls, duplicate_policy, columns=tuple(frame.columns), **bindings)


def resolve_columns(frame: DataFrame, requested) -> tuple[str, ...]:
    """Each name must match exactly one column, and none may repeat."""
    out = []
    for name in requested:
        if frame.columns.count(name) != 1:
            raise Refusal("READINESS_COLUMN_AMBIGUOUS", f"{name} matches {frame.columns.count(name)} columns")
        out.append(name)
    if len(out) != len(set(out)):
        raise Refusal("READINESS_DUPLICATE_COLUMN", "a column is named twice")
    return tuple(out)


def value_kind(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.lit("boolean")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.lit("integer")
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.lit("number")
    if isinstance(dtype, T.ArrayType):
        return F.lit("array")
    if isinstance(dtype, (T.StructType, T.MapType)):
        return F.lit("object")
    if isinstance(dtype, T.VariantType):
        shape = F.schema_of_variant(column)
        return (
            F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "BIGINT", "integer")
            .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("number")
        )
    return F.lit("string")


def order_token(column: Column, dtype: T.DataType, nulls: str) -> Column:
    """(null rank, kind, canonical text) as one string that sorts the same way.

    Numbers sort as text inside their kind. The kind is left out where the column has only
    one. Canonical text never holds a NUL, which separates the parts.
    """
    missing = is_missing(column, dtype)
    rank = {"nulls_first": "0", "nulls_last": "2", "nulls_error": "2"}[nulls]
    absent = F.lit(rank)
    if nulls == "nulls_error":
        absent = F.when(missing, F.raise_error(F.lit("READINESS_NULL_IN_KEY"))).otherwise(absent)
    parts = [F.lit("1"), json_value(column, dtype)]
    if isinstance(dtype, T.VariantType):
        parts = [F.lit("1"), value_kind(column, dtype), F.lit("\x00"), json_value(column, dtype)]
    return F.when(missing, absent).otherwise(F.concat(*parts))


def tokenised(frame: DataFrame, spec: SortSpec, extra: tuple[str, ...] = (), content: list[str] | None = None) -> DataFrame:
    """Rows as (_order, requested columns): the order key, as bytes, ends with those of the record hash (of the columns ``content``,
    all by default), so equal keys mean equal records."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    tokens = [order_token(F.col(f"`{name}`"), types[name], spec.nulls) for name in spec.keys + spec.tie_break]
    head = F.concat_ws("\x00", *tokens, F.lit("")).cast("binary")
    return frame.select(F.concat(head, F.unhex(record_hash(frame, content))).alias("_order"), *[F.col(f"`{c}`") for c in extra])


def hash_bytes() -> Column:
    return F.substring("_order", -HASH_BYTES, HASH_BYTES)


def hash_of_order() -> Column:
    return F.lower(F.hex(hash_bytes()))


def in_total_order(frame: DataFrame, spec: SortSpec) -> DataFrame:
    """The table sorted by key tokens, tie-break tokens and record hash (spilling range sort)."""
    kept = tuple(frame.columns)
    return tokenised(frame, spec, kept).orderBy("_order").select(*[f"`{c}`" for c in kept], hash_of_order().alias("record_sha256"))


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, with their number: a record that is a third of all rows is a few of a task's rows."""
    for batch in batches:
        counted = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([([], "count_all")])
        yield from counted.select([*batch.schema.names, "count_all"]).rename_columns([*batch.schema.names, "copies"]).to_batches()


def runs_of(tokens: DataFrame) -> DataFrame:
    """Identical records counted, in ranges of their order: (the columns of ``tokens``, copies).

    Copies are counted within a batch first and then in their range, so the rows are shuffled once for the count and the order.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields)
    parts = tokens.mapInArrow(combined, f"{schema}, copies long")
    return parts.repartitionByRange(tasks_for(tokens), "_order").groupBy(*tokens.columns).agg(F.sum("copies").alias("copies"))


def placed_runs(tokens: DataFrame, name: str = "ordinal", step: str | None = None) -> DataFrame:
    """The runs with their position in the total order, stored once."""
    return with_positions(runs_of(tokens), [F.col("_order")], name, step, ranged=True)


def ordered_runs(frame: DataFrame, spec: SortSpec) -> DataFrame:
    """Total order as runs of identical records: (record_sha256, copies, position)."""
    placed = placed_runs(tokenised(frame, spec), "position", "copies")
    return placed.select(hash_of_order().alias("record_sha256"), "copies", "position")


def normalised_digest(frame: DataFrame, spec: SortSpec) -> DataFrame:
    """One row (order_sha256): digest of the runs in total order."""
    return runs_digest(placed_runs(tokenised(frame, spec)))


def runs_digest(placed: DataFrame) -> DataFrame:
    """Digest of runs (_order, copies, ordinal)."""
    run = packed_run(hash_bytes(), F.col("copies"))
    return order_digest(placed.select("ordinal", run.alias("run")), "ordinal", "run", shown=lambda r: run_text(r, "*"))


def rebuilt_digest(frame: DataFrame, spec: SortSpec, placed: DataFrame) -> DataFrame:
    """One row (order_sha256): the digest made again from the source, in another arrangement and without the first one's shuffle, sort and positions.

    Of the first build only the key that begins each block of positions is taken (one in 65,536). The records go straight to
    their blocks, in reversed batches, and are counted and sorted there. Equal runs give an equal digest; a run more, less or other makes its block another.
    """
    starts = [bytes(r["_order"]) for r in placed.where(F.col("ordinal") % BLOCK == 0).select("_order").orderBy("_order").collect()]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in combined(b.take(pa.array(range(b.num_rows - 1, -1, -1))) for b in batches):
            block = [max(0, bisect_right(starts, key) - 1) for key in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *batch.columns], names=["_b", "_order", "copies"])

    rows = tokenised(frame, spec).mapInArrow(dealt, "_b long, _order binary, copies long")
    runs = rows.repartition(tasks_for(frame, len(starts) * BLOCK), "_b").groupBy("_b", "_order").agg(F.sum("copies").alias("copies"))
    entries = F.sort_array(F.collect_list(F.struct("_order", "copies")))
    shown = F.transform(entries, lambda e: F.concat(F.lower(F.hex(F.substring(e["_order"], -HASH_BYTES, HASH_BYTES))), F.lit("*"), e["copies"].cast("string")))
    blocks = runs.groupBy("_b").agg(F.sha2(F.array_join(shown, ","), 256).alias("_d"))
    return order_digest(blocks, "_b", "_d", levels=BLOCK_LEVELS - 1)


def lane_sort(frame: DataFrame, keys, tie_break=(), nulls: str = "nulls_last") -> DataFrame:
    """Raw-file lane: keys as text, tie-breaks case-folded, record hash last."""
    def null_last(name, fold):
        text = F.col(name).cast("string")
        empty = F.coalesce(text, F.lit("")) == ""
        rank = F.when(empty, 0 if nulls == "nulls_first" else 2).otherwise(1)
        return [rank, F.lower(text) if fold else text]

    order = [c for k in keys for c in null_last(k, False)] + [c for t in tie_break for c in null_last(t, True)]
    return frame.withColumn("record_sha256", record_hash(frame)).orderBy(*order, "record_sha256")


def order_dependent_groups(frame: DataFrame, keys, tie_break=()) -> DataFrame:
    """Sort-key groups with more than one distinct record: their order would depend on the input."""
    keyed = frame.select(
        *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)],
        *[F.lower(F.coalesce(F.col(t).cast("string"), F.lit(""))).alias(f"t{i}") for i, t in enumerate(tie_break)],
        record_hash(frame).alias("record_sha256"),
    )
    names = [c for c in keyed.columns if c != "record_sha256"]
    distinct = keyed.groupBy(*names, "record_sha256").agg(F.count(F.lit(1)).alias("copies"))
    return (
        distinct.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("distinct_records"), F.sum("copies").alias("records"))
        .filter("distinct_records > 1")
    )
