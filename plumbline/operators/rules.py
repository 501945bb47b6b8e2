"""Claim and evidence rules as finding rows.

Every entity table is scanned once: all its rules are evaluated in that pass and the
rules that fire are exploded into (gate, code, severity, status, subject) rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.operators import rule_tables as R
from plumbline.operators.integrity import safe_relative_path
from plumbline.session import tasks_for

PROFILES = ("exploratory", "standard", "strict", "submission")
WHITESPACE = " \t\n\r\x0b\x0c"
STRICT = ("strict", "submission")
NOT_EXPLORATORY = ("standard", "strict", "submission")


@dataclass(frozen=True)
class Rule:
    code: str
    gate: int
    when: Column
    profiles: tuple[str, ...] = PROFILES
    softened: bool = False  # a warning under the exploratory profile


def evaluate(rows: DataFrame, subject: Column, rules: Sequence[Rule], profile: str) -> DataFrame:
    if profile not in PROFILES:
        raise Refusal("AUDIT_PROFILE_UNKNOWN", profile)
    fired = []
    for rule in rules:
        if profile not in rule.profiles:
            continue
        soft = rule.softened and profile == "exploratory"
        fired.append(F.when(F.coalesce(rule.when, F.lit(False)), F.struct(
            F.lit(rule.gate).alias("gate"), F.lit(rule.code).alias("code"),
            F.lit("warning" if soft else "blocker").alias("severity"), F.lit("WARN" if soft else "FAIL").alias("status"))))
    if not fired:
        return rows.limit(0).select(F.lit(0).alias("gate"), F.lit("").alias("code"), F.lit("").alias("severity"),
                                    F.lit("").alias("status"), F.lit("").alias("subject"))
    return rows.select(subject.cast("string").alias("subject"), F.explode(F.array_compact(F.array(*fired))).alias("f")).select(
        "f.gate", "f.code", "f.severity", "f.status", "subject")


def text(name: str) -> Column:
    return F.btrim(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(WHITESPACE))


def shorter(name: str, minimum: int) -> Column:
    return F.length(text(name)) < minimum


def listed(name: str) -> Column:
    """Non-blank entries of an array column."""
    return F.filter(F.coalesce(F.col(name), F.expr("cast(array() as array<string>)")), lambda x: F.btrim(x, F.lit(WHITESPACE)) != "")


def matches(column: Column, pattern: str) -> Column:
    return column.rlike("(?is)" + pattern)


# ---- gate 1 -----------------------------------------------------------------------------


def text_rules(column: Column, is_question: Column | None = None) -> list[Rule]:
    """Wording rules of one text; every pattern is tried in one pass over the text."""
    rules = [
        Rule("PLACEHOLDER_LANGUAGE", 1, matches(column, R.PLACEHOLDER)),
        Rule("VAGUE_EVALUATIVE_TERM", 1, matches(column, R.VAGUE) & ~matches(column, R.MEASURED), softened=True),
        Rule("UNBOUNDED_CERTAINTY", 1, matches(column, R.ABSOLUTE)),
        Rule("GLOBAL_NOVELTY_OVERCLAIM", 1, matches(column, R.GLOBAL_NOVELTY)),
        Rule("LOADED_FRAMING", 1,
             matches(column, R.LOADED) & (~is_question if is_question is not None else F.lit(True)), softened=True),
    ]
    rules += [Rule(code, 1, matches(column, pattern), softened=True) for code, pattern in R.FALLACIES.items()]
    return rules


def vague_terms(column: Column) -> Column:
    """Distinct sorted vague words of a text (lower case)."""
    found = F.regexp_extract_all(F.lower(column), F.lit(R.VAGUE), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def wording_findings(rows: DataFrame, pointer: str, column: str, profile: str, question: str | None = None) -> DataFrame:
    is_question = F.col(pointer) == question if question else None
    return evaluate(rows, F.col(pointer), text_rules(F.col(column), is_question), profile)


def project_rules(profile: str) -> list[Rule]:
    """Rules over one project row: see PROJECT_COLUMNS for the columns they read."""
    wide = 2 if profile in STRICT else 1
    dated = text("novelty_search_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(
        text("novelty_search_date"), "yyyy-MM-dd").isNotNull()
    novelty = F.lower(text("novelty_status"))
    return [
        Rule("QUESTION_UNDERSPECIFIED", 1, shorter("question", 8)),
        Rule("HYPOTHESIS_UNDERSPECIFIED", 1, shorter("hypothesis", 24)),
        Rule("FALSIFIER_MISSING", 1, shorter("falsifier", 16)),
        Rule("OPERATIONAL_DEFINITIONS_MISSING", 1,
             F.coalesce(F.size(F.map_keys("operational_definitions")), F.lit(0)) == 0, softened=True),
        Rule("SUCCESS_CRITERIA_MISSING", 1, F.size(listed("success_criteria")) == 0, softened=True),
        Rule("NEUTRAL_FRAME_MISSING", 1, shorter("neutral_restatement", 16)),
        Rule("COMPETING_FRAME_MISSING", 1, F.size(listed("competing_frames")) == 0, STRICT),
        Rule("SCOPE_BOUNDARIES_MISSING", 1, F.size(listed("scope_boundaries")) == 0, NOT_EXPLORATORY),
        Rule("NOVELTY_SEARCH_NOT_STARTED", 1, ~novelty.isin("complete", "in_progress"), ("exploratory",), softened=True),
        Rule("NOVELTY_SEARCH_INCOMPLETE", 1, (novelty != "complete") | ~F.coalesce(dated, F.lit(False)), NOT_EXPLORATORY),
        Rule("NOVELTY_SEARCH_THIN", 1,
             (F.size(listed("databases")) < wide) | (F.size(listed("queries")) < wide)
             | (F.size(listed("nearest_prior_work")) == 0) | (F.size(listed("differentiators")) == 0), NOT_EXPLORATORY),
        Rule("NEGATIVE_SEARCH_MISSING", 1, F.size(listed("negative_searches")) == 0, ("submission",)),
    ]


def project_findings(projects: DataFrame, profile: str) -> DataFrame:
    return evaluate(projects, F.col("project_id"), project_rules(profile), profile)


# ---- gate 2 -----------------------------------------------------------------------------


def absent_children(parents: DataFrame, children: DataFrame, key: str, code: str, gate: int, profile: str,
                    profiles: tuple[str, ...] = PROFILES, softened: bool = False) -> DataFrame:
    """One finding per parent that has no child row at all."""
    lonely = parents.select(key).join(children.select(key).distinct(), key, "left_anti")
    return evaluate(lonely, F.col(key), [Rule(code, gate, F.lit(True), profiles, softened)], profile)


def evidence_field_findings(evidence: DataFrame, profile: str) -> DataFrame:
    rules = [Rule("EVIDENCE_ARTIFACT_MISSING", 2, text("artifact_path") == "")]
    rules += [
        Rule(code, 2, shorter(name, minimum), softened=True)
        for name, (minimum, code) in R.EVIDENCE_FIELDS.items() if name in evidence.columns
    ]
    return evaluate(evidence, F.col("id"), rules, profile)


def evidence_file_findings(evidence: DataFrame, manifest: DataFrame, profile: str) -> DataFrame:
    """Evidence artifacts against the file manifest (relative_path, sha256, actual_sha256).

    actual_sha256 is NULL when the file is unavailable.
    """
    rows = evidence.filter(text("artifact_path") != "").select("id", text("artifact_path").alias("_path"),
                                                               F.col("sha256").alias("_declared"))
    files = manifest.select(F.col("relative_path").alias("_path"), F.col("sha256").alias("_listed"),
                            F.col("actual_sha256").alias("_actual"), F.lit(True).alias("_in"))
    joined = rows.join(files, "_path", "left")
    safe = safe_relative_path(F.col("_path"))
    known = F.coalesce(F.col("_in"), F.lit(False))
    declared = F.coalesce(F.col("_declared"), F.lit(""))
    rules = [
        Rule("EVIDENCE_PATH_INVALID", 2, ~safe | (known & F.col("_actual").isNull())),
        Rule("EVIDENCE_NOT_MANIFESTED", 2, safe & ~known),
        Rule("EVIDENCE_HASH_MISMATCH", 2, safe & known & (F.col("_actual") != F.col("_listed"))),
        Rule("EVIDENCE_DECLARED_DIGEST_MISMATCH", 2,
             safe & known & F.col("_actual").isNotNull()
             & (~declared.rlike(r"^[0-9a-f]{64}$") | (declared != F.col("_actual")))),
    ]
    return evaluate(joined, F.col("id"), rules, profile)


def duplicate_citation_sources(evidence: DataFrame) -> DataFrame:
    """Artifact and locator pairs cited by more than one primary record."""
    return (
        evidence.filter(F.coalesce("primary", F.lit(False)) & (text("artifact_path") != "") & (text("source_locator") != ""))
        .groupBy(text("artifact_path").alias("artifact_path"), text("source_locator").alias("source_locator"))
        .agg(F.count(F.lit(1)).alias("citations")).filter("citations > 1")
    )


def duplicate_citation_findings(evidence: DataFrame, profile: str) -> DataFrame:
    """The same groups as findings, with the artifact, the locator and the citing records as their evidence.

    A hot source is one finding; its record ids are one list, as a reader of the finding needs them all.
    """
    cited = (
        evidence.filter(F.coalesce("primary", F.lit(False)) & (text("artifact_path") != "") & (text("source_locator") != ""))
        .groupBy(text("artifact_path").alias("artifact_path"), text("source_locator").alias("source_locator"))
        .agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("ids")).filter(F.size("ids") > 1)
    )
    subject = F.concat_ws("\n", "artifact_path", "source_locator")
    found = evaluate(cited, subject, [Rule("DUPLICATE_CITATION_SOURCE", 2, F.lit(True), softened=True)], profile)
    told = cited.select(subject.alias("subject"), F.concat(F.array("artifact_path", "source_locator"), F.col("ids")).alias("evidence"), F.concat(F.lit("Evidence "), F.array_join("ids", ", ")).alias("_shown"))
    return found.join(told, "subject").select("gate", "code", "severity", "status", F.col("_shown").alias("subject"), "evidence")


def claim_field_findings(claims: DataFrame, profile: str) -> DataFrame:
    rules = [
        Rule("CLAIM_INCOMPLETE", 2, shorter("statement", 16)),
        Rule("CLAIM_SCOPE_INCOMPLETE", 2,
             shorter("population", 3) | shorter("setting", 3) | shorter("timeframe", 3), NOT_EXPLORATORY),
        Rule("CLAIM_FALSIFIER_MISSING", 2, shorter("falsifier", 12)),
    ]
    return evaluate(claims, F.col("claim_id"), rules, profile)


def claim_support(references: DataFrame, evidence: DataFrame, tasks: int | None = None) -> DataFrame:
    """Facts per claim from (claim_id, evidence_id, role SUPPORT or COUNTER) rows.

    The tasks grow with the references. A task holds its share of the evidence while the references stream past it, and one
    small row per claim, so a claim or an evidence row cited by a third of everything takes no more memory than others.
    """
    tasks = tasks or max(tasks_for(references), tasks_for(evidence))
    rows = evidence.select(
        F.col("id").alias("evidence_id"), F.lit(True).alias("_known"), F.col("primary").alias("_primary"),
        F.lower(text("directness")).alias("_direct"), F.lower(text("source_type")).alias("_source"),
        F.lower(text("kind")).alias("_kind"),
    )
    role = [F.col("role") == "SUPPORT", F.col("role") == "COUNTER"]
    marks = references.select("claim_id", "evidence_id", role[0].alias("_s"), role[1].alias("_c")).repartition(tasks, "claim_id", "evidence_id")
    roles = marks.groupBy("claim_id", "evidence_id").agg(F.max(F.col("_s").cast("int")).alias("_s"), F.max(F.col("_c").cast("int")).alias("_c"))
    joined = roles.repartition(tasks, "evidence_id").join(rows.repartition(tasks, "evidence_id").hint("shuffle_hash"), "evidence_id", "left")
    known = F.col("_known").isNotNull()
    support = known & (F.col("_s") == 1)
    facts = joined.select(
        "claim_id", known.alias("_known"), support.alias("_support"), "_s", "_c", (support & F.col("_primary") & (F.col("_direct") == "direct")).alias("_dp"),
        (support & F.col("_source").isin(*R.SECONDARY_SOURCE_TYPES)).alias("_secondary"),
        (support & F.col("_kind").isin("observational", "correlational")).alias("_observed"))
    return facts.repartition(tasks, "claim_id").groupBy("claim_id").agg(
        F.count_if("_support").alias("known_support"),
        F.count_if(~F.col("_known")).alias("unknown_references"),
        F.count_if("_dp").alias("direct_primary"),
        F.count_if("_secondary").alias("secondary_support"),
        F.count_if("_observed").alias("observational_support"),
        F.count_if((F.col("_s") == 1) & (F.col("_c") == 1)).alias("both_roles"),
        F.count_if(F.col("_s") == 1).alias("support_ids"),
        F.count_if(F.col("_c") == 1).alias("counter_ids"),
    )


def claim_evidence_findings(claims: DataFrame, references: DataFrame, evidence: DataFrame, profile: str) -> DataFrame:
    """Gate 2 and gate 3 rules that need the evidence of a claim."""
    tasks = max(tasks_for(claims), tasks_for(references), tasks_for(evidence))
    facts = claim_support(references, evidence, tasks)
    joined = claims.repartition(tasks, "claim_id").join(facts.hint("merge"), "claim_id", "left")

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    unreconciled = shorter("reconciliation", 16)
    rules = [
        Rule("UNKNOWN_EVIDENCE_REFERENCE", 2, n("unknown_references") > 0),
        Rule("CLAIM_UNSUPPORTED", 2, n("known_support") == 0, softened=True),
        Rule("MAJOR_CLAIM_LACKS_DIRECT_PRIMARY_EVIDENCE", 2,
             (F.col("importance") == "major") & (n("known_support") > 0) & (n("direct_primary") == 0)),
        Rule("UNRECONCILED_EVIDENCE_ROLE", 2, (n("both_roles") > 0) & unreconciled),
        Rule("SECONDARY_ONLY_SUPPORT", 2,
             (n("known_support") > 0) & (n("secondary_support") == n("known_support")), softened=True),
        Rule("CAUSAL_CLAIM_FROM_OBSERVATIONAL_EVIDENCE", 2,
             matches(text("statement"), R.CAUSAL) & (n("observational_support") > 0) & shorter("causal_identification", 16)),
        Rule("COUNTEREVIDENCE_UNRECONCILED", 3, (n("counter_ids") > 0) & unreconciled),
        Rule("TOTAL_EVIDENCE_ROLE_CONFLICT", 3,
             (n("both_roles") > 0) & (n("both_roles") == n("support_ids")) & (n("both_roles") == n("counter_ids"))),
    ]
    return evaluate(joined, F.col("claim_id"), rules, profile)


def attestation_findings(projects: DataFrame, profile: str) -> DataFrame:
    def unset(name: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit(False))

    rules = [Rule(f"ATTESTATION_{name.upper()}", 2, unset(name), softened=True) for name in R.ATTESTATIONS]
    rules.append(Rule("NEGATIVE_RESULTS_ATTESTATION_MISSING", 3, unset("null_and_negative_results_declared"), STRICT))
    return evaluate(projects, F.col("project_id"), rules, profile)


def receipt_findings(projects: DataFrame, receipts: DataFrame, profile: str) -> DataFrame:
    """Fresh PASS receipt per project.

    projects: project_id, records_sha256, reproducibility_command; receipts: project_id,
    receipt_id, status, post_records_sha256, finished_at, started_at, intact.
    """
    good = receipts.filter("intact").groupBy("project_id", F.col("post_records_sha256").alias("records_sha256")).agg(
        F.count_if(F.col("status") == "PASS").alias("_fresh"))
    latest = receipts.filter("intact").groupBy("project_id").agg(
        F.max_by("status", F.struct("finished_at", "started_at", "receipt_id")).alias("_latest"))
    damaged = receipts.filter("not intact").select("project_id", "receipt_id")
    joined = projects.join(good, ["project_id", "records_sha256"], "left").join(latest, "project_id", "left")
    command = text("reproducibility_command")
    excused = command.rlike(R.NOT_APPLICABLE)
    rules = [
        Rule("REPRODUCIBILITY_COMMAND_MISSING", 2, command == "", STRICT),
        Rule("FRESH_PASS_RECEIPT_MISSING", 2,
             (command != "") & ~excused
             & ((F.coalesce("_fresh", F.lit(0)) == 0) | (F.coalesce("_latest", F.lit("")) != "PASS")), STRICT),
    ]
    return evaluate(joined, F.col("project_id"), rules, profile).unionByName(
        evaluate(damaged, F.col("receipt_id"), [Rule("RECEIPT_DAMAGED", 2, F.lit(True))], profile))


# ---- gate 3 -----------------------------------------------------------------------------


def method_findings(methods: DataFrame, profile: str) -> DataFrame:
    """Method completeness; ``not_applicable: REASON`` (8 characters or more) excuses a field."""
    rules = [
        Rule(code, 3, shorter(name, minimum) & ~text(name).rlike(R.NOT_APPLICABLE), softened=True)
        for name, (minimum, code) in R.METHOD_FIELDS.items() if name in methods.columns
    ]
    if "sample_size" in methods.columns:
        rules.append(Rule("SAMPLE_SIZE_MISSING", 3,
                          F.col("kind").isin("research", "hybrid") & (F.coalesce(F.col("sample_size"), F.lit(0)) <= 0), STRICT))
    if "controls" in methods.columns:
        rules.append(Rule("CONTROLS_MISSING", 3, F.size(listed("controls")) == 0, NOT_EXPLORATORY))
        rules.append(Rule("EXCLUSIONS_UNDECLARED", 3, F.size(listed("exclusions")) == 0, STRICT))
    return evaluate(methods, F.col("project_id"), rules, profile)


def assumption_findings(rows: DataFrame, profile: str) -> DataFrame:
    short = shorter("statement", 8) | shorter("risk", 8) | shorter("test", 8)
    return evaluate(rows, F.col("id"), [Rule("ASSUMPTION_INCOMPLETE", 3, short)], profile)


def adversarial_findings(rows: DataFrame, profile: str) -> DataFrame:
    short = F.lit(False)
    for name in ("target", "procedure", "failure_condition", "result", "status"):
        short = short | shorter(name, 3)
    open_ = ~F.lower(text("status")).isin("pass", "passed", "complete", "failed_as_expected")
    return evaluate(rows, F.col("id"), [
        Rule("ADVERSARIAL_TEST_INCOMPLETE", 3, short),
        Rule("ADVERSARIAL_TEST_NOT_RESOLVED", 3, open_, ("submission",)),
    ], profile)


def contradiction_findings(rows: DataFrame, profile: str) -> DataFrame:
    settled = F.lower(text("status")).isin("resolved", "explained", "claim_narrowed", "inconclusive")
    return evaluate(rows, F.col("id"), [
        Rule("CONTRADICTION_UNRESOLVED", 3, ~settled | shorter("resolution", 12))], profile)


def waiver_findings(rows: DataFrame, profile: str) -> DataFrame:
    refused = F.lower(text("severity")).isin("blocker", "critical", "mandatory")
    return evaluate(rows, F.col("id"), [Rule("MANDATORY_GATE_WAIVER_REFUSED", 3, refused)], profile)


def ethics_findings(rows: DataFrame, profile: str) -> DataFrame:
    risks, answers = F.size(listed("risks")), F.size(listed("mitigations"))
    return evaluate(rows, F.col("project_id"), [
        Rule("ETHICS_STATUS_MISSING", 3, text("review_status") == ""),
        Rule("ETHICS_RISK_UNMITIGATED", 3, (risks > 0) & (answers < risks), ("submission",)),
    ], profile)


def missing_submission_fields() -> Column:
    """Names of the submission fields that are absent."""
    return F.array_compact(F.array(
        F.when(shorter("field", 3), "field"),
        F.when(F.size(listed("target_venues")) == 0, "target_venues"),
        F.when(F.size(listed("author_names")) == 0, "author_names"),
        F.when(shorter("corresponding_author", 3), "corresponding_author"),
        F.when(shorter("data_availability", 12), "data_availability"),
        F.when(shorter("code_availability", 12), "code_availability"),
    ))


def submission_gaps(rows: DataFrame, profile: str) -> DataFrame:
    """The submission findings with the names of the missing fields as their evidence."""
    named = rows.select(F.col("project_id").cast("string").alias("subject"), missing_submission_fields().alias("evidence"))
    return submission_findings(rows, profile).join(named, "subject").select("gate", "code", "severity", "status", "subject", "evidence")


def submission_findings(rows: DataFrame, profile: str) -> DataFrame:
    return evaluate(rows, F.col("project_id"), [
        Rule("SUBMISSION_METADATA_INCOMPLETE", 3, F.size(missing_submission_fields()) > 0, ("submission",))], profile)


COLLECTION_RULES = {
    "assumptions": "ASSUMPTIONS_UNDECLARED",
    "alternative_explanations": "ALTERNATIVE_EXPLANATIONS_MISSING",
    "adversarial_tests": "ADVERSARIAL_TESTS_MISSING",
    "reviewer_objections": "REVIEWER_OBJECTIONS_MISSING",
    "limitations": "LIMITATIONS_MISSING",
}


def collection_findings(projects: DataFrame, collections: dict[str, DataFrame], profile: str) -> DataFrame:
    """Collections that strict profiles require at least one row in."""
    out = None
    for name, code in COLLECTION_RULES.items():
        if name in collections:
            part = absent_children(projects, collections[name], "project_id", code, 3, profile, STRICT)
            out = part if out is None else out.unionByName(part)
    return out


def structure_findings(violations: DataFrame, profile: str) -> DataFrame:
    """Structural violations (subject, pointer, problem) as gate 1 findings."""
    subject = F.concat("subject", "pointer")
    return evaluate(violations, subject, [Rule("SCHEMA_STRUCTURE", 1, F.lit(True))], profile)


def duplicate_claim_findings(pairs: DataFrame, profile: str) -> DataFrame:
    """Near-duplicate statement pairs as findings."""
    subject = F.concat_ws("/", F.col("left_id").cast("string"), F.col("right_id").cast("string"))
    return evaluate(pairs, subject, [Rule("DUPLICATE_CLAIM", 1, F.lit(True), softened=True)], profile)
