"""The 22-check readiness gate over a declared record identity."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import Refusal
from plumbline.functions.canon import is_missing, json_value, record_hash, record_hashes
from plumbline.operators.digest import multiset_digest
from plumbline.operators.ordering import (
    IDENTITY_RULE, SortSpec, hash_bytes, placed_runs, rebuilt_digest, runs_digest, tokenised)

# The check matrix, in order.
REQUIRED_CHECKS = (
    "source_identity",
    "record_identity",
    "schema",
    "encoding",
    "type_normalization",
    "datetime_normalization",
    "numeric_locale",
    "category_normalization",
    "duplicate_handling",
    "join_keys_and_cardinality",
    "missingness",
    "exclusions",
    "transformations",
    "stable_deterministic_sorting",
    "tie_break_rules",
    "null_ordering",
    "order_invariance",
    "row_reconciliation",
    "cross_platform_fixture_equivalence",
    "rebuild_hash_equality",
    "analysis_plan_binding",
    "independent_verification",
)


@dataclass(frozen=True)
class SourceFacts:
    """What was measured about the source outside the table itself. What is not known does not pass.

    ``receipts.measured`` takes these facts of a published version; a bare frame has none.
    """

    verified: bool | None = None  # stored hashes, digests and lineage recompute
    identity: bool | None = None  # what the declaration binds is what is published now
    plan_sha256: str | None = None  # digest of the declared plan file as it is now
    encoding_ok: bool | None = None  # None: measured over the text columns of the table


def key_counts(frame: DataFrame, spec: SortSpec) -> DataFrame:
    """One row: rows, key groups, repeated key groups, rows in them, and key cells that are missing.

    Missing keys form groups of their own here, because identity is what is tested.
    """
    types = {f.name: f.dataType for f in frame.schema.fields}
    parts = [json_value(F.col(f"`{k}`"), types[k]).alias(f"_p{i}") for i, k in enumerate(spec.keys)]
    misses = [
        F.sum(is_missing(F.col(f"`{k}`"), types[k]).cast("long")).alias(f"_m{i}")
        for i, k in enumerate(spec.keys + spec.tie_break)
    ]
    groups = frame.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"), *misses)
    missing = sum((F.col(f"_m{i}") for i in range(len(misses))), F.lit(0))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("key_groups"),
        F.count_if(F.col("_n") > 1).alias("duplicate_key_count"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("null_key_cells"),
    )


def _metric_rows(frame: DataFrame) -> DataFrame:
    """One-row frame -> (metric, value) rows, so one-row results can be unioned and pivoted."""
    pairs = F.create_map(*[x for c in frame.columns for x in (F.lit(c), F.col(c).cast("string"))])
    return frame.select(F.explode(pairs).alias("metric", "value"))


def invalid_text(frame: DataFrame) -> Column:
    """Whether a text of the row is not valid UTF-8."""
    wrong = [~F.is_valid_utf8(F.col(f"`{f.name}`")) for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    return F.coalesce(reduce(lambda x, y: x | y, [F.coalesce(w, F.lit(False)) for w in wrong], F.lit(False)), F.lit(False))


def identity_runs(frame: DataFrame, spec: SortSpec) -> DataFrame:
    """Distinct records with their order key, key, copies and position, stored once: every count
    and the first digest of the gate are taken from this table instead of the source.

    Missing keys form key groups of their own, NULL apart from empty text.
    """
    relaxed = replace(spec, nulls="nulls_last") if spec.nulls == "nulls_error" else spec
    types = {f.name: f.dataType for f in frame.schema.fields}
    names = spec.keys + spec.tie_break
    tokens = tokenised(frame.withColumn("_invalid", invalid_text(frame)), relaxed, (*names, "_invalid"), content=frame.columns)
    key = F.concat_ws("\x00", *[json_value(F.col(f"`{n}`"), types[n]) for n in spec.keys])
    missing = sum((is_missing(F.col(f"`{n}`"), types[n]).cast("int") for n in names), F.lit(0))
    return placed_runs(tokens.select("_order", key.alias("_key"), missing.cast("int").alias("_missing"), "_invalid"))


def _run_counts(runs: DataFrame) -> DataFrame:
    groups = runs.groupBy("_key").agg(
        F.sum("copies").alias("_n"), F.sum(F.col("copies") * F.col("_missing")).alias("_miss"), F.sum(F.when(F.col("_invalid"), F.col("copies")).otherwise(0)).alias("_bad"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("key_groups"),
        F.count_if(F.col("_n") > 1).alias("duplicate_key_count"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.coalesce(F.sum("_miss"), F.lit(0)).alias("null_key_cells"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid_text_rows"),
    )


def readiness_counts(frame: DataFrame, spec: SortSpec, rebuild: bool = True) -> DataFrame:
    """Every measured fact of the gate in one row.

    The ordered digest is built twice, the second time from the source again, in reversed batches and by
    another shuffle: equality shows both order invariance and rebuild equality.
    """
    resolved = bool(spec.keys) and all(frame.columns.count(c) == 1 for c in spec.keys + spec.tie_break)
    facts = []
    if not resolved:
        facts.append(_metric_rows(frame.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(invalid_text(frame)).alias("invalid_text_rows"))))
        facts.append(_metric_rows(multiset_digest(record_hashes(frame)).drop("row_count")))
    else:
        runs = identity_runs(frame, spec)
        facts.append(_metric_rows(_run_counts(runs)))
        facts.append(_metric_rows(multiset_digest(runs.select(hash_bytes().alias("record_sha256"), "copies"), "record_sha256", "copies").drop("row_count")))
        blocked = spec.nulls == "nulls_error" and _run_counts(runs).first()["null_key_cells"] > 0
        if not blocked:
            first = runs_digest(runs)
            facts.append(_metric_rows(first.withColumnRenamed("order_sha256", "normalized_sha256")))
            if rebuild:
                second = rebuilt_digest(frame, spec, runs)
                facts.append(_metric_rows(second.withColumnRenamed("order_sha256", "rebuilt_sha256")))
    rows = facts[0]
    for more in facts[1:]:
        rows = rows.unionByName(more)

    def pick(name: str, kind: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value"))).cast(kind).alias(name)

    return rows.agg(
        *[pick(n, "long") for n in
          ("row_count", "distinct_count", "key_groups", "duplicate_key_count", "rows_in_duplicate_groups", "null_key_cells", "invalid_text_rows")],
        *[pick(n, "string") for n in ("records_sha256", "normalized_sha256", "rebuilt_sha256")],
    )


def readiness_checks(frame: DataFrame, spec: SortSpec, source: SourceFacts = SourceFacts(),
                     counts: DataFrame | None = None) -> DataFrame:
    """22 rows (position, check_id, status, evidence).

    Source identity and independent verification pass only for a source that was measured (``SourceFacts``): a bare frame
    is bound to nothing and verified by nobody. Without a declared plan there is none to be bound.
    """
    counts = counts if counts is not None else readiness_counts(frame, spec)
    resolved = bool(spec.keys) and all(frame.columns.count(c) == 1 for c in spec.keys + spec.tie_break)
    identity_only = tuple(spec.normalization) == (IDENTITY_RULE,)
    exact = spec.duplicate_policy == "exact"
    no_duplicates = (F.coalesce("duplicate_key_count", F.lit(0)) == 0) | F.lit(exact)
    blocked = F.lit(spec.nulls == "nulls_error") & (F.coalesce("null_key_cells", F.lit(0)) > 0)
    sorted_ok = F.lit(resolved) & ~blocked & F.col("normalized_sha256").isNotNull()
    rebuilt = sorted_ok & F.coalesce(F.col("normalized_sha256") == F.col("rebuilt_sha256"), F.lit(False))
    nonempty = F.col("row_count") > 0
    bound = F.lit(bool(source.identity)) & (
        F.lit(True) if spec.source_records_sha256 is None else F.col("records_sha256") == F.lit(spec.source_records_sha256))
    readable = F.coalesce(F.col("invalid_text_rows") == 0, F.lit(False)) if source.encoding_ok is None else F.lit(source.encoding_ok)
    passed: dict[str, Column] = {
        "source_identity": bound,
        "record_identity": F.lit(resolved),
        "schema": F.lit(tuple(spec.columns) == tuple(frame.columns)),
        "encoding": readable,
        "type_normalization": F.lit(identity_only),
        "datetime_normalization": F.lit(identity_only),
        "numeric_locale": F.lit(identity_only),
        "category_normalization": F.lit(identity_only),
        "duplicate_handling": no_duplicates,
        "join_keys_and_cardinality": no_duplicates,
        "missingness": ~blocked,
        "exclusions": F.lit(not spec.exclusions),
        "transformations": F.lit(identity_only),
        "stable_deterministic_sorting": sorted_ok,
        "tie_break_rules": F.lit(resolved),
        "null_ordering": ~blocked,
        "order_invariance": rebuilt & nonempty,
        "row_reconciliation": sorted_ok & nonempty,
        "cross_platform_fixture_equivalence": sorted_ok,
        "rebuild_hash_equality": rebuilt,
        "analysis_plan_binding": F.lit(spec.plan_sha256 == source.plan_sha256),
        "independent_verification": F.lit(bool(source.verified)),
    }
    evidence = {
        "duplicate_handling": ("duplicate_key_count", "row_count"),
        "join_keys_and_cardinality": ("duplicate_key_count",),
        "missingness": ("null_key_cells",),
        "null_ordering": ("null_key_cells",),
        "row_reconciliation": ("row_count",),
        "source_identity": ("records_sha256",),
        "encoding": ("invalid_text_rows",),
        "rebuild_hash_equality": ("normalized_sha256", "rebuilt_sha256"),
    }
    may_block = {"missingness", "null_ordering"}
    rows = []
    for place, check in enumerate(REQUIRED_CHECKS):
        bad = F.lit("BLOCKED" if check in may_block else "FAIL")
        names = evidence.get(check, ())
        facts = (
            F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit("")))])
            if names else F.expr("cast(map() as map<string,string>)")
        )
        rows.append(F.struct(
            F.lit(place).alias("position"), F.lit(check).alias("check_id"),
            F.when(passed[check], "PASS").otherwise(bad).alias("status"), facts.alias("evidence"),
        ))
    return counts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def readiness_decision(checks: DataFrame) -> DataFrame:
    """Counts by status and the decision: BLOCKED beats FAIL beats PASS."""
    count = {s: F.count_if(F.col("status") == s) for s in ("PASS", "FAIL", "BLOCKED")}
    binding = F.sha2(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(
            "=", F.lpad(F.col("position").cast("string"), 2, "0"), "check_id", "status"))), ","), 256)
    return checks.agg(
        count["PASS"].alias("passed"), count["FAIL"].alias("failed"), count["BLOCKED"].alias("blocked"),
        F.when(count["BLOCKED"] > 0, "BLOCKED").when(count["FAIL"] > 0, "FAIL").otherwise("PASS").alias("decision"),
        binding.alias("binding_sha256"),  # exactly 22 entries
    )


def stale_receipts(receipts: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Receipt verification: receipts whose decision or binding no longer recomputes."""
    now = recomputed.select("dataset", F.col("decision").alias("_decision"), F.col("binding_sha256").alias("_binding"))
    joined = receipts.join(now, "dataset", "left")
    same = (F.col("decision") == F.col("_decision")) & (F.col("binding_sha256") == F.col("_binding"))
    return joined.withColumn("current", F.coalesce(same, F.lit(False))).drop("_decision", "_binding")


def readiness_status(receipts: DataFrame, active: DataFrame, current: DataFrame) -> DataFrame:
    """State per dataset.

    receipts(dataset, receipt_id, records_sha256, decision, intact), active(dataset,
    receipt_id), current(dataset, records_sha256). States: NONE, AMBIGUOUS, TAMPERED,
    STALE, or the decision of the selected receipt.
    """
    pointers = active.groupBy("dataset").agg(
        F.count_distinct("receipt_id").alias("_pointers"), F.max("receipt_id").alias("_active"))
    known = receipts.groupBy("dataset").agg(F.count(F.lit(1)).alias("_receipts"))
    chosen = receipts.select(
        "dataset", F.col("receipt_id").alias("_active"), F.col("records_sha256").alias("_bound"), "decision", "intact")
    joined = (
        current.join(known, "dataset", "left").join(pointers, "dataset", "left")
        .join(chosen, ["dataset", "_active"], "left")
    )
    several = (F.coalesce("_pointers", F.lit(0)) > 1) | (
        F.col("_pointers").isNull() & (F.coalesce("_receipts", F.lit(0)) > 1))
    state = (
        F.when(F.coalesce("_receipts", F.lit(0)) == 0, "NONE")
        .when(several, "AMBIGUOUS")
        .when(F.col("decision").isNull(), "NONE")
        .when(~F.col("intact"), "TAMPERED")
        .when(F.col("_bound") != F.col("records_sha256"), "STALE")
        .otherwise(F.col("decision"))
    )
    return joined.select("dataset", F.col("_active").alias("receipt_id"), state.alias("state"))


def require_ready(checks: DataFrame) -> None:
    """Refuse to go on unless all 22 checks pass (reads one row)."""
    row = readiness_decision(checks).first()
    if row["decision"] != "PASS" or row["passed"] != len(REQUIRED_CHECKS):
        raise Refusal("READINESS_REQUIRED", f"decision is {row['decision']}", **row.asDict())
