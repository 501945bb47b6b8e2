"""Gate decisions, failure classes, gaps and open items over finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canon import json_text, record_hash
from plumbline.operators import rule_tables as R

MANDATORY_GATES = (0, 1, 2, 3)


def gate_status(findings: DataFrame) -> DataFrame:
    """FAIL for a gate with any failed blocker."""
    bad = (F.col("severity") == "blocker") & (F.col("status") == "FAIL")
    return findings.groupBy("gate").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(bad).alias("failed_blockers"),
        F.when(F.bool_or(bad), "FAIL").otherwise("PASS").alias("gate_status"))


def audit_status(findings: DataFrame) -> DataFrame:
    bad = F.count_if((F.col("severity") == "blocker") & (F.col("status") == "FAIL"))
    return findings.agg(bad.alias("failed_blockers"), F.count_if(F.col("status") == "WARN").alias("warnings"),
                        F.when(bad > 0, "FAIL").otherwise("PASS").alias("audit_status"))


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def failure_status(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(R.FAILURE_STATUS), code), F.lit(R.DEFAULT_FAILURE))


def failure_severity(status: Column) -> Column:
    return F.coalesce(F.try_element_at(_table({k: v[0] for k, v in R.FAILURE_CLASSES.items()}), status), F.lit("BLOCKING"))


def failure_group(status: Column) -> Column:
    return F.coalesce(F.try_element_at(_table({k: v[1] for k, v in R.FAILURE_CLASSES.items()}), status), F.lit("unsupported"))


def classified(findings: DataFrame, code: str = "code") -> DataFrame:
    status = failure_status(F.col(code))
    return findings.withColumns({
        "failure_status": status, "failure_severity": failure_severity(status), "failure_group": failure_group(status)})


def owning_check(gate: Column, code: Column) -> Column:
    """The mandatory check of a gate that a finding of that gate belongs to; NULL if none does."""
    owners = F.create_map(*[F.lit(x) for (number, name), check in R.CHECK_OWNERS.items() for x in (f"{number}/{name}", check)])
    return F.try_element_at(owners, F.concat_ws("/", gate.cast("string"), code))


def owned_findings(findings: DataFrame) -> DataFrame:
    """Findings with the mandatory check that owns them; those of no check are left out."""
    return findings.withColumn("check_id", owning_check(F.col("gate"), F.col("code"))).filter("check_id is not null")


def gate_counts(checks: DataFrame, by: str = "gate", required: DataFrame | None = None) -> DataFrame:
    """Check counts per gate and the decision: blocked first, then failed by priority,
    then open questions, else PASS. checks(by, check_id, status).

    With ``required`` (by, check_id) the number of required checks of the gate comes first.
    """
    fails = [s for s in R.FAILURE_CLASSES if s.startswith("FAIL_") or s.startswith("FRAMING")]
    blocks = [s for s in R.FAILURE_CLASSES if s.startswith("BLOCKED_")]
    status = F.col("status")

    def first_of(classes: list[str]) -> Column:
        place = F.array_position(F.array(*[F.lit(c) for c in classes]), status)
        return F.min_by(status, F.when(place > 0, place))

    blocked, failed = F.count_if(status.isin(*blocks)), F.count_if(status.isin(*fails))
    counts = checks.groupBy(by).agg(
        F.count(F.lit(1)).alias("executed_check_count"),
        F.count_if(status == "PASS").alias("passed_check_count"),
        failed.alias("failed_check_count"), blocked.alias("blocked_check_count"),
        F.count_if(status == "NOT_APPLICABLE").alias("not_applicable_count"),
        (failed + blocked).alias("unresolved_blocker_count"),
        F.when(blocked > 0, first_of(blocks)).when(failed > 0, first_of(fails))
        .when(F.count_if(status == "NEEDS_CLARIFICATION") > 0, "NEEDS_CLARIFICATION").otherwise("PASS").alias("decision"),
    )
    if required is None:
        return counts
    wanted = required.groupBy(by).agg(F.count_distinct("check_id").alias("required_check_count"))
    return counts.join(wanted, by, "left").withColumn("required_check_count", F.coalesce("required_check_count", F.lit(0)))


def check_membership(checks: DataFrame, required: DataFrame, by: str = "gate") -> DataFrame:
    """Checks that are missing, unexpected or repeated, per gate."""
    have = checks.groupBy(by, "check_id").agg(F.count(F.lit(1)).alias("_have"))
    want = required.select(by, "check_id", F.lit(1).alias("_want"))
    both = have.join(want, [by, "check_id"], "full_outer")
    problem = (
        F.when(F.col("_have").isNull(), "CHECK_MISSING").when(F.col("_want").isNull(), "CHECK_UNEXPECTED")
        .when(F.col("_have") > 1, "CHECK_REPEATED")
    )
    return both.select(by, "check_id", problem.alias("problem")).filter("problem is not null")


def gate_zero(state: Column) -> Column:
    """Readiness state -> gate 0 decision."""
    return (
        F.when(state == "PASS", "PASS").when(state == "FAIL", "FAIL_DATA_NOT_READY")
        .when(state == "STALE", "FAIL_STALE").when(state == "TAMPERED", "FAIL_TAMPERED")
        .when(state == "AMBIGUOUS", "BLOCKED_AMBIGUOUS_IDENTITY").when(state == "BLOCKED", "BLOCKED_AMBIGUOUS_DEFINITION")
        .otherwise("BLOCKED_MISSING_ARTIFACT")
    )


def gated(decisions: DataFrame, subject: str = "project_id") -> DataFrame:
    """Other gates count as blocked while gate 0 is not PASS."""
    zero = decisions.filter("gate = 0").select(subject, F.col("decision").alias("_zero"))
    held = (F.col("gate") > 0) & ~F.col("_zero").eqNullSafe(F.lit("PASS"))
    return decisions.join(zero, subject, "left").select(
        *[F.when(held, "BLOCKED_BY_GATE_0").otherwise(F.col("decision")).alias("decision") if c == "decision" else F.col(c)
          for c in decisions.columns])


def latest_decisions(decisions: DataFrame, subject: str = "project_id") -> DataFrame:
    """Newest decision per (project, gate); equal times are settled by the record id."""
    newest = F.max_by(F.struct("decision", "decided_at", "record_id", "binding_digest", "unresolved_blocker_count"),
                      F.struct("decided_at", "record_id"))
    return decisions.groupBy(subject, "gate").agg(newest.alias("n")).select(subject, "gate", "n.*")


def eligibility_blockers(projects: DataFrame, latest: DataFrame, verifier: DataFrame) -> DataFrame:
    """(project_id, blocker, gate) rows; a project without rows is eligible.

    projects(project_id, binding_digest); latest as from latest_decisions; verifier(project_id,
    verifier_decision, verified_digest).
    """
    gates = projects.select("project_id", F.col("binding_digest").alias("_live"), F.explode(
        F.array(*[F.lit(g) for g in MANDATORY_GATES])).alias("gate"))
    joined = gates.join(latest, ["project_id", "gate"], "left")
    by_gate = joined.select("project_id", "gate", F.explode(F.array_compact(F.array(
        F.when(F.col("decision").isNull(), "GATE_NOT_DECIDED"),
        F.when(F.col("decision") != "PASS", "GATE_NOT_PASS"),
        F.when((F.col("decision") == "PASS") & ~F.col("binding_digest").eqNullSafe(F.col("_live")), "GATE_OTHER_BINDING"),
        F.when(F.coalesce("unresolved_blocker_count", F.lit(0)) > 0, "UNRESOLVED_BLOCKERS"),
    ))).alias("blocker"))
    checked = projects.join(verifier, "project_id", "left").select(
        "project_id", F.lit(None).cast("int").alias("gate"), F.explode(F.array_compact(F.array(
            F.when(~F.col("verifier_decision").eqNullSafe(F.lit("PASS")), "VERIFIER_NOT_PASS"),
            F.when((F.col("verifier_decision") == "PASS")
                   & ~F.col("verified_digest").eqNullSafe(F.col("binding_digest")), "VERIFIER_OTHER_BINDING"),
        ))).alias("blocker"))
    return by_gate.unionByName(checked)


def binding_digests(parts: DataFrame, subject: str = "project_id") -> DataFrame:
    """One digest per project over (section, item) rows as sorted sets, folded in two levels
    by item-hash prefix so that no group grows with a project. Hashes are bytes while they are shuffled."""
    hashed = F.unhex(F.sha2(F.concat_ws("=", "section", "item"), 256))
    items = parts.select(subject, hashed.alias("_h")).distinct()
    text = lambda h: F.lower(F.hex(h))

    def folded(prefix: str, size: int) -> Column:
        """Digest of the sorted ``prefix=digest`` of a level; prefixes of one length sort as bytes as they do as text."""
        packed = F.sort_array(F.collect_list(F.concat(F.col(prefix).cast("binary"), "_d")))
        shown = F.transform(packed, lambda x: F.concat(F.substring(x, 1, size).cast("string"), F.lit("="), text(F.substring(x, size + 1, 32))))
        return F.sha2(F.array_join(shown, ","), 256)

    leaf = items.groupBy(subject, F.substring(text(F.substring("_h", 1, 3)), 1, 5).alias("_p")).agg(
        F.unhex(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("_h")), text), ","), 256)).alias("_d"))
    inner = leaf.groupBy(subject, F.substring("_p", 1, 2).alias("_q")).agg(F.unhex(folded("_p", 5)).alias("_d"))
    return inner.groupBy(subject).agg(folded("_q", 2).alias("binding_digest"))


def verification_errors(declared: DataFrame, recomputed: DataFrame, gates: DataFrame) -> DataFrame:
    """Digest re-verification: (project_id, error, gate) rows; PASS when there are none."""
    live = recomputed.select("project_id", F.col("binding_digest").alias("_live"))
    top = declared.join(live, "project_id", "left").filter(
        ~F.col("binding_digest").eqNullSafe(F.col("_live"))
    ).select("project_id", F.lit("DECLARED_DIGEST").alias("error"), F.lit(None).cast("int").alias("gate"))
    by_gate = gates.join(live, "project_id", "left").filter(
        ~F.col("binding_digest").eqNullSafe(F.col("_live"))
    ).select("project_id", F.lit("GATE_DIGEST").alias("error"), F.col("gate").cast("int"))
    return top.unionByName(by_gate)


def nonblocking(limitations: DataFrame, subject: str = "project_id") -> DataFrame:
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in
             ("scope_excludes_affected", "recorded_in_payload", "deterministic_rule", "independent_verifier_confirms")]
    every = flags[0] & flags[1] & flags[2] & flags[3]
    return limitations.groupBy(subject).agg(
        F.count(F.lit(1)).alias("limitations"), F.bool_and(every).alias("conditions_met"))


def gap_rows(findings: DataFrame) -> DataFrame:
    """Gap rows with a content-derived id. findings: gate, code, subject, message."""
    status = failure_status(F.col("code"))
    identity = F.concat(
        F.lit('{"affected_artifacts":[],"affected_claims":['), json_text(F.col("subject")),
        F.lit('],"failure_code":'), json_text(F.col("code")), F.lit(',"gate":'), F.col("gate").cast("string"),
        F.lit(',"observed_fact":'), json_text(F.col("message")), F.lit(',"why_it_matters":""}\n'))
    blank = {n: F.lit("") for n in (
        "why_it_matters", "what_remains_valid", "minimum_repair", "preferred_repair", "best_sorting_or_collection_method",
        "evidence_needed", "user_action_needed", "own_action_available", "external_action_needed", "completion_condition",
        "verification_command")}
    return findings.select(
        F.substring(F.sha2(identity, 256), 1, 16).alias("gap_id"), "gate", F.col("code").alias("failure_code"),
        failure_severity(status).alias("severity"), F.col("message").alias("observed_fact"),
        F.array("subject").alias("affected_claims"), F.expr("cast(array() as array<string>)").alias("affected_artifacts"),
        F.expr("cast(array() as array<string>)").alias("alternative_repairs"),
        *[v.alias(k) for k, v in blank.items()],
        F.lit("open").alias("status"), F.lit("REQUIRES_SOURCE_ARTIFACT").alias("action"),
    )


def fingerprint() -> Column:
    fields = ("code", "gate", "message", "subject")
    parts = []
    for i, name in enumerate(fields):
        value = F.col(name).cast("string") if name == "gate" else json_text(F.col(name))
        parts += [F.lit(("," if i else "{") + f'"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.sha2(F.concat(*parts, F.lit("}\n")), 256)


def sync_open_items(state: DataFrame, findings: DataFrame, now: str) -> DataFrame:
    """Next state of the open items: new blockers open, returning ones reopen, gone ones resolve.

    state: fingerprint_sha256, status, created_at, last_seen_at, resolved_at, note. The result
    is a whole new state to be written as the next version.
    """
    blockers = findings.filter("severity = 'blocker'").select(fingerprint().alias("fingerprint_sha256")).distinct()
    joined = state.join(blockers.withColumn("_seen", F.lit(True)), "fingerprint_sha256", "full_outer")
    seen = F.coalesce("_seen", F.lit(False))
    closing = ~seen & (F.col("status") == "open")
    stamp = F.lit(now)
    return joined.select(
        "fingerprint_sha256",
        F.when(seen, "open").when(closing, "resolved").otherwise(F.col("status")).alias("status"),
        F.coalesce("created_at", stamp).alias("created_at"),
        F.when(seen, stamp).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(seen, F.lit(None).cast("string")).when(closing, stamp).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.when(seen, "").when(closing, "resolved by the latest audit").otherwise(F.col("note")).alias("note"),
    )


def apply_status_updates(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Manual open or resolved updates with a note (one update per item)."""
    change = updates.select("fingerprint_sha256", F.col("status").alias("_status"), F.col("note").alias("_note"))
    return state.join(change, "fingerprint_sha256", "left").select(
        *[F.coalesce("_status", "status").alias("status") if c == "status"
          else F.coalesce("_note", "note").alias("note") if c == "note" else F.col(c) for c in state.columns])


def decision_cards(rows: DataFrame) -> DataFrame:
    """Self-hashed decision rows."""
    return rows.withColumn("card_sha256", record_hash(rows))
