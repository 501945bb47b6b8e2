"""Projections that show no more than was asked for."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.functions.canon import canonical_record, json_text, record_hash
from plumbline.operators.integrity import media_family
from plumbline.operators.ordering import resolve_columns

MAX_SELECTED_ORDINALS = 100_000


def projected(frame: DataFrame, columns: Sequence[str], ordinal: str, redact: bool = False) -> DataFrame:
    """Chosen columns with the hash of the whole record and the bytes shown per row."""
    columns = list(resolve_columns(frame, columns))
    hashed = frame.withColumn("record_sha256", record_hash(frame))
    if redact:
        shown = [F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in columns]
        size = F.lit(0).cast("long")
    else:
        shown = [F.col(f"`{c}`") for c in columns]
        size = F.octet_length(canonical_record(frame, columns)).cast("long")
    return hashed.select(F.col(f"`{ordinal}`").alias("ordinal"), "record_sha256", *shown, size.alias("shown_bytes"))


def bounded_projection(frame: DataFrame, columns: Sequence[str], ordinal: str, row_indices: Sequence[int],
                       row_limit: int, byte_limit: int, redact: bool = False) -> DataFrame:
    """Declared rows only; over a limit the projection is refused, never cut short."""
    wanted = sorted(set(row_indices))
    if len(wanted) > min(row_limit, MAX_SELECTED_ORDINALS):
        raise Refusal("PROJECTION_ROW_LIMIT", f"{len(wanted)} rows requested")
    spark = frame.sparkSession
    chosen = spark.createDataFrame([(i,) for i in wanted], "ordinal long")  # bounded by MAX_SELECTED_ORDINALS
    rows = projected(frame, columns, ordinal, redact).join(F.broadcast(chosen), "ordinal")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("shown_bytes"), F.lit(0)).alias("b")).first()
    if facts["n"] != len(wanted):
        raise Refusal("PROJECTION_ROW_MISSING", f"{len(wanted) - facts['n']} ordinals do not exist")
    if facts["b"] > byte_limit:
        raise Refusal("PROJECTION_BYTE_LIMIT", f"{facts['b']} bytes exceed {byte_limit}")
    return rows


def salted_alias(kind: str, salt_name: str, salt, id_name: str, identifier):
    """``kind-`` plus 16 hex characters of the hash of {salt, id}."""
    first, second = sorted([(salt_name, json_text(salt)), (id_name, json_text(identifier))])
    body = F.concat(F.lit('{"' + first[0] + '":'), first[1], F.lit(',"' + second[0] + '":'), second[1], F.lit("}\n"))
    return F.concat(F.lit(kind + "-"), F.substring(F.sha2(body, 256), 1, 16))


def public_references(references: DataFrame, export_id: str, limit: int) -> DataFrame:
    """References with aliases instead of ids; PRIVATE rows stay behind. Over the limit: refused."""
    visible = references.filter("disclosure <> 'PRIVATE'")
    n = visible.count()
    if n > limit:
        raise Refusal("EXPORT_RESOURCE_LIMIT", f"{n} references exceed {limit}")
    return alias_references(visible, export_id)


def alias_references(visible: DataFrame, export_id: str) -> DataFrame:
    return visible.select(
        salted_alias("source", "export_id", F.lit(export_id), "ref_id", F.col("ref_id")).alias("source_ref_alias"),
        "role", media_family(F.col("media_type")).alias("media_family"), "size_bytes",
        F.col("sha256").alias("content_sha256"), "disclosure", F.lit("METADATA_ONLY").alias("body_policy"),
    )


def counts_only(entities: dict[str, DataFrame], presence: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(entity, row_count, fields present somewhere) and nothing of the content."""
    out = None
    for name, frame in sorted(entities.items()):
        flags = [F.when(F.max(F.col(f"`{c}`").isNotNull().cast("int")) == 1, F.lit(c)) for c in (presence or {}).get(name, ())]
        one = frame.agg(F.count(F.lit(1)).alias("row_count"),
                        F.array_compact(F.array(*flags)).alias("present_fields") if flags
                        else F.expr("cast(array() as array<string>)").alias("present_fields"))
        one = one.select(F.lit(name).alias("entity"), "row_count", "present_fields")
        out = one if out is None else out.unionByName(one)
    return out


def fill_packets(records: DataFrame, budget: int) -> DataFrame:
    """Greedy packet filling: keep full content while the running bytes fit, else metadata only.

    records(packet, position, meta_bytes, full_bytes) -> + kept, refused. A packet whose
    metadata alone is over the budget is refused before grouping, so a group that reaches
    the sequential step has at most budget / smallest-metadata rows. Only sizes travel.
    """
    totals = records.groupBy("packet").agg(F.sum("meta_bytes").alias("_meta"))
    sized = records.join(totals, "packet")
    refused = sized.filter(F.col("_meta") > budget).select(
        "packet", "position", "meta_bytes", "full_bytes", F.lit(False).alias("kept"), F.lit(True).alias("refused"))
    floor = F.when(F.col("meta_bytes") > 0, F.col("meta_bytes")).otherwise(
        F.raise_error(F.lit("PACKET_METADATA_EMPTY")).cast("long"))
    fitting = sized.filter(F.col("_meta") <= budget).withColumn("meta_bytes", floor).drop("_meta")
    kind = records.schema["packet"].dataType.simpleString()

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        used, kept = 0, []
        for meta, full in zip(group["meta_bytes"], group["full_bytes"]):
            fits = used + full <= budget
            used += full if fits else meta
            kept.append(fits)
        over = used > budget
        return group.assign(kept=kept, refused=over)[
            ["packet", "position", "meta_bytes", "full_bytes", "kept", "refused"]]

    done = fitting.groupBy("packet").applyInPandas(
        greedy, f"packet {kind}, position long, meta_bytes long, full_bytes long, kept boolean, refused boolean")
    return done.unionByName(refused)
