"""Record contracts as rule rows: each rule is a predicate over one column, and every row
that breaks it gives one violation row (subject, pointer, problem)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.functions.canon import record_hash
from plumbline.operators.integrity import duplicate_ids, safe_relative_path, unknown_references

KINDS = (
    "required", "const", "enum", "pattern", "min_length", "max_length", "minimum", "maximum", "min_items", "max_items",
    "unique_items", "safe_path", "sha256", "iso_instant", "type",
)


@dataclass(frozen=True)
class FieldRule:
    column: str
    kind: str
    argument: object = None


def _broken(rule: FieldRule) -> Column:
    value = F.col(rule.column)
    arg = rule.argument
    present = value.isNotNull()
    if rule.kind == "required":
        return ~present
    if rule.kind == "const":
        return present & (value != F.lit(arg))
    if rule.kind == "enum":
        return present & ~value.isin(*arg)
    if rule.kind == "pattern":
        return present & ~value.rlike(arg)
    if rule.kind == "min_length":
        return present & (F.char_length(value) < arg)
    if rule.kind == "max_length":
        return present & (F.char_length(value) > arg)
    if rule.kind == "minimum":
        return present & (value < F.lit(arg))
    if rule.kind == "maximum":
        return present & (value > F.lit(arg))
    if rule.kind == "min_items":
        return present & (F.size(value) < arg)
    if rule.kind == "max_items":
        return present & (F.size(value) > arg)
    if rule.kind == "unique_items":
        return present & (F.size(F.array_distinct(value)) < F.size(value))
    if rule.kind == "safe_path":
        return present & ~safe_relative_path(value)
    if rule.kind == "sha256":
        return present & ~value.rlike("^[0-9a-f]{64}$")
    if rule.kind == "iso_instant":
        return present & F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00")).isNull()
    if rule.kind == "type":
        return present & value.try_cast(arg).isNull()
    raise Refusal("CONTRACT_RULE_UNKNOWN", rule.kind)


def violations(rows: DataFrame, subject: str, rules: Sequence[FieldRule],
               across: dict[str, Column] | None = None, closed: bool = False) -> DataFrame:
    """All broken field rules in one pass. ``across`` holds cross-field rules that must be
    true; ``closed`` refuses columns no rule knows."""
    found = [
        F.when(F.coalesce(_broken(r), F.lit(False)),
               F.struct(F.lit("/" + r.column).alias("pointer"), F.lit(r.kind.upper()).alias("problem")))
        for r in rules
    ]
    for name, holds in (across or {}).items():
        found.append(F.when(~F.coalesce(holds, F.lit(False)),
                            F.struct(F.lit("/").alias("pointer"), F.lit(name).alias("problem"))))
    if closed:
        known = {r.column for r in rules} | {subject}
        for name in rows.columns:
            if name not in known:
                found.append(F.struct(F.lit("/" + name).alias("pointer"), F.lit("UNKNOWN_FIELD").alias("problem")))
    return rows.select(F.col(subject).cast("string").alias("subject"), F.explode(F.array_compact(F.array(*found))).alias("v")).select(
        "subject", "v.pointer", "v.problem")


# Rule sets of the small records.
HEX = "^[0-9a-f]{64}$"
CHECKPOINT_RULES = (
    FieldRule("checkpoint_id", "required"), FieldRule("checkpoint_id", "pattern", "^gen-[0-9a-f]{16}$"),
    FieldRule("records_sha256", "required"), FieldRule("records_sha256", "sha256"),
    FieldRule("source_manifest_sha256", "required"), FieldRule("source_manifest_sha256", "sha256"),
    FieldRule("record_count", "required"), FieldRule("record_count", "minimum", 0),
    FieldRule("parent_id", "pattern", "^gen-[0-9a-f]{16}$"),
)
DELTA_ENTRY_RULES = (
    FieldRule("side", "required"), FieldRule("side", "enum", ("LEFT", "RIGHT")),
    FieldRule("ordinal", "required"), FieldRule("ordinal", "minimum", 0),
    FieldRule("source_record_sha256", "required"), FieldRule("source_record_sha256", "sha256"),
    FieldRule("key_sha256", "sha256"),
    FieldRule("classification", "required"),
    FieldRule("classification", "enum",
              ("UNCHANGED", "MODIFIED", "ADDED", "ABSENT", "CANDIDATE_DUPLICATE", "UNKNOWN")),
    FieldRule("counterpart_count", "minimum", 0), FieldRule("exact_counterpart_count", "minimum", 0),
    FieldRule("preserved", "const", True),
)


def delta_entry_violations(ledger: DataFrame) -> DataFrame:
    rows = ledger.withColumn("entry", F.concat_ws("/", "side", F.col("ordinal").cast("string")))
    across = {
        "EXACT_WITHIN_COUNTERPARTS": F.col("exact_counterpart_count") <= F.col("counterpart_count"),
        "UNKNOWN_HAS_NO_KEY": (F.col("classification") == "UNKNOWN") == F.col("key_sha256").isNull(),
        "CONFLICT_CLASS": ~F.col("conflict") | F.col("classification").isin("MODIFIED", "CANDIDATE_DUPLICATE"),
    }
    return violations(rows, "entry", DELTA_ENTRY_RULES, across)


def checkpoint_violations(rows: DataFrame) -> DataFrame:
    across = {"ID_RECOMPUTES": F.col("checkpoint_id") == checkpoint_id(F.col("records_sha256"), F.col("parent_id"))}
    return violations(rows, "checkpoint_id", CHECKPOINT_RULES, across)


def checkpoint_id(records_sha256: Column, parent_id: Column) -> Column:
    """Content-derived id that includes the parent link."""
    parent = F.coalesce(F.concat(F.lit('"'), parent_id, F.lit('"')), F.lit("null"))
    body = F.concat(F.lit('{"parent_generation_id":'), parent, F.lit(',"records_sha256":"'), records_sha256, F.lit('"}\n'))
    return F.concat(F.lit("gen-"), F.substring(F.sha2(body, 256), 1, 16))


def structure_violations(project: dict[str, DataFrame], links: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Ids unique per collection and every reference resolvable.

    project maps a collection to rows with an id; links are (collection, column, target
    collection, target column).
    """
    out = None
    for name, rows in sorted(project.items()):
        part = duplicate_ids(rows, "id").select(F.col("id").cast("string").alias("subject"), F.lit(f"/{name}/id").alias("pointer"),
                                                F.lit("DUPLICATE_ID").alias("problem"))
        out = part if out is None else out.unionByName(part)
    for name, column, target, target_column in links:
        part = unknown_references(project[name], "id", project[target], column, target_column).select(
            F.col("subject").cast("string").alias("subject"), F.lit(f"/{name}/{column}").alias("pointer"),
            F.lit("UNKNOWN_REFERENCE").alias("problem"))
        out = part if out is None else out.unionByName(part)
    return out


def run_structure_violations(runs: DataFrame, packages: DataFrame) -> DataFrame:
    """Run state against its work packages: runs(run_id, state, outcome), packages(run_id,
    package_id, status, deferred)."""
    from plumbline.operators.integrity import state_outcome

    open_ = packages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("status").isin("DONE", "DEFERRED")).alias("_open"),
        F.count_if(F.col("status") == "DEFERRED").alias("_deferred"))
    joined = runs.join(open_, "run_id", "left").fillna(0, ["_all", "_open", "_deferred"])
    complete = F.col("state").isin("COMPLETE", "COMPLETE_WITH_DEFERRED_SOFT_GATES")
    across = {
        "OUTCOME_MATCHES_STATE": F.col("outcome").eqNullSafe(state_outcome(F.col("state"))),
        "COMPLETE_HAS_NO_OPEN_PACKAGE": ~complete | (F.col("_open") == 0),
        "DEFERRAL_NEEDS_DEFERRED_STATE": (F.col("state") != "COMPLETE") | (F.col("_deferred") == 0),
        "HAS_PACKAGE": (F.col("state") == "DRAFT") | (F.col("_all") > 0),
    }
    return violations(joined, "run_id", [FieldRule("state", "required")], across)


def plan_summary(plans: DataFrame, required: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Unfinished plans: missing design fields per plan, and plan counts per label."""
    missing = F.array_compact(F.array(*[
        F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required]))
    return (plans.select("id", missing.alias("missing_fields")).filter(F.size("missing_fields") > 0),
            plans.groupBy(label).agg(F.count(F.lit(1)).alias("plans")))


# ---- verbatim entries -------------------------------------------------------------------


def entry_violations(entries: DataFrame) -> DataFrame:
    """entries: entry_id, exact_text, exact_text_sha256, summary, summary_sha256, revision, entry_hash."""
    body = [c for c in entries.columns if c != "entry_hash"]
    across = {
        "TEXT_HASH": F.col("exact_text_sha256") == F.sha2("exact_text", 256),
        "SUMMARY_HASH": F.col("summary").isNull() | (F.col("summary_sha256") == F.sha2("summary", 256)),
        "SUMMARY_DIFFERS": F.col("summary").isNull() | (F.col("summary") != F.col("exact_text")),
        "ENTRY_HASH": F.col("entry_hash") == record_hash(entries, body),
        "TEXT_PRESENT": F.trim("exact_text") != "",
    }
    found = violations(entries, "entry_id", [FieldRule("exact_text_sha256", "sha256"), FieldRule("revision", "minimum", 1)], across)
    repeated = duplicate_ids(entries, "entry_id").select(
        F.col("entry_id").cast("string").alias("subject"), F.lit("/entry_id").alias("pointer"), F.lit("DUPLICATE_ID").alias("problem"))
    return found.unionByName(repeated)


def link_violations(links: DataFrame, entries: DataFrame, relations: Sequence[str]) -> DataFrame:
    """links: link_id, entry_id, target_id, relation."""
    rules = [FieldRule("relation", "required"), FieldRule("relation", "enum", tuple(relations))]
    found = violations(links, "link_id", rules, {"NOT_SELF": F.col("entry_id") != F.col("target_id")})
    repeated = duplicate_ids(links, "entry_id", "target_id", "relation").select(
        F.concat_ws("/", F.col("entry_id").cast("string"), F.col("target_id").cast("string"), "relation").alias("subject"),
        F.lit("/").alias("pointer"), F.lit("DUPLICATE_LINK").alias("problem"))
    unknown = unknown_references(links, "link_id", entries, "entry_id", "entry_id").select(
        F.col("subject").cast("string").alias("subject"), F.lit("/entry_id").alias("pointer"),
        F.lit("UNKNOWN_REFERENCE").alias("problem"))
    return found.unionByName(repeated).unionByName(unknown)
