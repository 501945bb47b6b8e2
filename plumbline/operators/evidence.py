"""Evidence strength, claim classes, uncertainty, measurements, ranking and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canon import record_hash
from plumbline.operators.digest import order_digest
from plumbline.session import tasks_for

# Claim classes with their keywords, in order, and evidence floors
# (roles, independent sources, reproducibility command).
CLAIM_KEYWORDS = {
    "causal": ("cause", "causes", "caused", "leads to", "effect of", "impact of"),
    "associational": ("associated with", "correlated with", "linked to", "predicts"),
    "mechanistic": ("mechanism", "pathway", "mediates", "via"),
    "measurement": ("measures", "measured", "rate of", "level of", "quantity"),
    "classification": ("is a", "classified as", "category", "belongs to"),
}
DEFAULT_CLASS = "descriptive"
EVIDENCE_FLOORS = {
    "causal": (("primary", "control_comparison", "falsification_test"), 2, True),
    "associational": (("primary", "control_comparison"), 1, True),
    "mechanistic": (("primary", "step_verification"), 1, True),
    "measurement": (("primary", "calibration_record"), 1, True),
    "classification": (("primary", "taxonomy_definition"), 1, False),
    "descriptive": (("primary",), 1, False),
}
NARROWER = {"causal": "associational", "associational": "descriptive"}


def strength_vector(evidence: DataFrame, claims: DataFrame, receipts: DataFrame, findings: DataFrame) -> DataFrame:
    """Five dimensions per claim; any WEAK dimension makes the claim WEAK.

    evidence(claim_id, artifact_path, source_locator, primary), claims(claim_id,
    has_uncertainty), receipts(claim_id, status), findings(claim_id, severity, status).
    Sources are counted as distinct pairs from a first aggregation, so a source repeated
    many times stays one partial row.
    """
    sources = evidence.groupBy(
        "claim_id", F.coalesce("artifact_path", F.lit("")).alias("_a"), F.coalesce("source_locator", F.lit("")).alias("_l")
    ).agg(F.count(F.lit(1)).alias("_n"), F.count_if("primary").alias("_p"))
    per = sources.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("unique_sources"),
        F.count_if(F.col("_p") > 0).alias("unique_primary_sources"),
        (F.sum("_n") - F.count(F.lit(1))).alias("shared_lineage_count"),
        F.sum("_p").alias("primary_count"), (F.sum("_n") - F.sum("_p")).alias("inherited_count"),
    )
    passed = receipts.filter("status = 'PASS'").select("claim_id").distinct().withColumn("_pass", F.lit(True))
    blocked = findings.filter("severity in ('FATAL','BLOCKING') or status = 'FAIL'").select("claim_id").distinct().withColumn(
        "_blocked", F.lit(True))
    joined = claims.join(per, "claim_id", "left").join(passed, "claim_id", "left").join(blocked, "claim_id", "left")

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    vector = {
        "independence": F.when((n("unique_sources") >= 2) & (n("shared_lineage_count") == 0), "STRONG")
        .when(n("unique_sources") >= 1, "MODERATE").otherwise("WEAK"),
        "directness": F.when((n("primary_count") > 0) & (n("inherited_count") == 0), "STRONG")
        .when(n("primary_count") > 0, "MODERATE").otherwise("WEAK"),
        "precision_score": F.when(F.coalesce("has_uncertainty", F.lit(False)), "STRONG").otherwise("MODERATE"),
        "reproducibility": F.when(F.col("_pass").isNotNull(), "STRONG").otherwise("WEAK"),
        "integrity": F.when(F.col("_blocked").isNotNull(), "WEAK").otherwise("STRONG"),
    }
    scored = joined.select("claim_id", *[c.alias(k) for k, c in vector.items()], *[
        n(c).alias(c) for c in ("shared_lineage_count", "unique_sources", "unique_primary_sources")])
    values = F.array(*[F.col(k) for k in vector])
    return scored.withColumn("overall_status", F.when(F.array_contains(values, "WEAK"), "WEAK").when(
        F.array_contains(values, "MODERATE"), "MODERATE").otherwise("STRONG"))


def claim_class(statement: Column, declared: Column | None = None, word_boundary: bool = False) -> Column:
    """Declared class, else the first class with a keyword in the statement."""
    lowered = F.lower(F.trim(statement))
    label = F.lit(DEFAULT_CLASS)
    for name, words in reversed(CLAIM_KEYWORDS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | (lowered.rlike(rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])") if word_boundary
                         else F.contains(lowered, F.lit(word)))
        label = F.when(hit, name).otherwise(label)
    if declared is None:
        return label
    given = F.lower(F.trim(declared))
    known = F.when(given.isin(*EVIDENCE_FLOORS), given).otherwise(F.raise_error(F.lit("CLAIM_CLASS_UNKNOWN")))
    return F.when(F.coalesce(given, F.lit("")) != "", known).otherwise(label)


def evidence_floor(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence floor per claim: claims(claim_id, claim_class, reproducibility_command),
    evidence(claim_id, role, artifact_path, source_locator, primary)."""
    roles = sorted({r for needed, _, _ in EVIDENCE_FLOORS.values() for r in needed})
    have = evidence.groupBy("claim_id").agg(*[
        F.max((F.lower("role") == r).cast("int")).alias(f"_r_{r}") for r in roles])
    pairs = evidence.filter("primary").groupBy("claim_id", "artifact_path", "source_locator").agg(F.lit(1).alias("_x"))
    sources = pairs.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_sources"))
    joined = claims.join(have, "claim_id", "left").join(sources, "claim_id", "left")
    kind = F.col("claim_class")

    def of_class(index: int, dtype: str) -> Column:
        table = F.create_map(*[x for k, v in EVIDENCE_FLOORS.items() for x in (F.lit(k), F.lit(v[index]))])
        return F.try_element_at(table, kind).cast(dtype)

    missing = F.array_compact(F.array(*[
        F.when(kind.isin(*[k for k, v in EVIDENCE_FLOORS.items() if r in v[0]])
               & (F.coalesce(F.col(f"_r_{r}"), F.lit(0)) == 0), F.lit(r)) for r in roles]))
    lacks_command = of_class(2, "boolean") & (F.trim(F.coalesce("reproducibility_command", F.lit(""))) == "")
    sources_n = F.coalesce("_sources", F.lit(0))
    out = joined.withColumns({
        "missing_roles": missing, "lacks_reproducibility": lacks_command, "independent_sources_count": sources_n,
        "minimum_sources_required": of_class(1, "int"),
    })
    met = (F.size("missing_roles") == 0) & ~F.col("lacks_reproducibility") & (
        F.col("independent_sources_count") >= F.col("minimum_sources_required"))
    narrower = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in NARROWER.items() for x in p]), kind), kind)
    return out.withColumn("met", met).select(
        "claim_id", "claim_class", F.when(F.col("met"), kind).otherwise(narrower).alias("effective_class"), "met",
        "missing_roles", "lacks_reproducibility", "independent_sources_count", "minimum_sources_required",
        (~F.col("met") & (narrower != kind)).alias("narrowed"))


def uncertainty_budget(components: DataFrame, by: str, value: str, unquantified: Column | None = None) -> DataFrame:
    """Root sum of squares per claim and the certainty ceiling."""
    open_ = unquantified if unquantified is not None else F.col(value).isNull()
    per = components.groupBy(by).agg(
        F.sqrt(F.coalesce(F.sum(F.col(value) * F.col(value)), F.lit(0.0))).alias("combined_standard_uncertainty"),
        F.count(value).alias("known_components"), F.count_if(open_).alias("unquantified_sources"))
    u = F.col("combined_standard_uncertainty")
    ceiling = F.when(F.col("unquantified_sources") > 0, "unquantified").when(u < 0.05, "high").when(
        u < 0.20, "moderate").otherwise("low")
    return per.withColumn("certainty_ceiling", ceiling).withColumn(
        "blocks_strong_claim", F.col("certainty_ceiling").isin("low", "unquantified"))


def confidence_refusal(percentage: Column, calibrated: Column) -> Column:
    """NULL when accepted, else the refusal code."""
    return F.when(~F.coalesce(percentage.between(0, 100), F.lit(False)), "CONFIDENCE_OUT_OF_RANGE").when(
        ~F.coalesce(calibrated, F.lit(False)), "UNCALIBRATED_CONFIDENCE_REFUSED")


# Unit to dimension.
UNITS = {
    "count": "dimensionless",
    "percent": "ratio",
    "fraction": "ratio",
    "seconds": "time",
    "milliseconds": "time",
    "meters": "length",
    "kilograms": "mass",
    "usd": "currency",
}


def measurement_records(rows: DataFrame) -> DataFrame:
    """Normalised unit, dimension and record hash; an unusable unit is refused as a row."""
    unit = F.lower(F.trim("unit"))
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    refused = ~unit.isin(*UNITS) & ~F.coalesce(unit.rlike(r"^[\p{L}\p{N}]+$"), F.lit(False))
    clean = rows.withColumns({"unit": unit, "dimension": F.coalesce(F.try_element_at(table, unit), F.lit("custom"))})
    return clean.withColumns({"sha256": record_hash(clean), "refusal": F.when(refused, "MEASUREMENT_INVALID_UNIT")})


def compatibility(pairs: DataFrame, left: str = "a_", right: str = "b_") -> DataFrame:
    """Measurement pairs: unit, dimension, time-zone and scale mismatches."""
    u1, u2 = F.col(left + "unit"), F.col(right + "unit")
    d1, d2 = F.col(left + "dimension"), F.col(right + "dimension")
    z1, z2 = F.col(left + "timezone"), F.col(right + "timezone")
    unit, dimension = ~u1.eqNullSafe(u2), ~d1.eqNullSafe(d2)
    zone = ~z1.eqNullSafe(z2) & ((d1 == "time") | (d2 == "time"))
    scale = ((u1 == "percent") & (u2 == "fraction")) | ((u1 == "fraction") & (u2 == "percent"))
    return pairs.withColumns({
        "unit_mismatch": unit, "dimension_mismatch": dimension, "timezone_mismatch": zone, "ratio_mismatch": scale,
        "errors": F.array_compact(F.array(
            F.when(dimension, "DIMENSION").when(unit & ~scale, "UNIT"), F.when(zone, "TIMEZONE"), F.when(scale, "SCALE"))),
        "status": F.when(unit | dimension | zone | scale, "FAIL_MEASUREMENT_MISMATCH").otherwise("PASS"),
    })


def discrepancies(pairs: DataFrame, expected: str, actual: str, threshold: float, boundary: Column) -> DataFrame:
    """Difference of two values (text values differ by 0 or 1) and whether it matters."""
    a, b = F.col(expected).try_cast("double"), F.col(actual).try_cast("double")
    differs = F.when(F.col(expected).eqNullSafe(F.col(actual)), 0.0).otherwise(1.0)
    with_diff = pairs.withColumn("difference", F.coalesce(F.abs(a - b), differs))
    material = (F.col("difference") > threshold) | ((F.col("difference") > 0) & boundary)
    return with_diff.withColumn("is_material", material).withColumn(
        "status", F.when(F.col("is_material"), "FAIL_MATERIAL_DISCREPANCY").when(
            F.col("difference") > 0, "IMMATERIAL_RECORDED").otherwise("PASS_EXACT"))


def required_depth(rows: DataFrame) -> DataFrame:
    """Depth from four boolean triggers of a claim."""
    names = {
        "is_high_stakes": "high_stakes_claim", "is_near_threshold": "near_decision_boundary",
        "has_conflicting_observations": "conflicting_observations", "is_weakly_corroborated": "weakly_corroborated",
    }
    fired = F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in names.items()]))
    depth = F.when(F.col("is_high_stakes") | F.col("is_near_threshold"), "microscopic").when(
        F.size("triggers_fired") > 0, "deep").otherwise("standard")
    return rows.withColumn("triggers_fired", fired).withColumn("required_depth", depth)


def stopping_rule(rows: DataFrame, findings: DataFrame, by: str = "claim_id") -> DataFrame:
    """rows(by, current_depth, required_depth, resources_exhausted), findings(by, is_material)."""
    material = findings.groupBy(by).agg(F.bool_or("is_material").alias("_material"))
    joined = rows.join(material, by, "left")
    open_ = F.coalesce("_material", F.lit(False))
    short = F.col("resources_exhausted") & (F.col("current_depth") != F.col("required_depth"))
    return joined.withColumns({
        "action": F.when(open_, "DEEPEN_REVIEW").when(short, "EMIT_CONTINUATION_PACKET").otherwise("SEAL_DEPTH_RECEIPT"),
        "status": F.when(open_, "FAIL_MATERIAL_DISCREPANCY_UNRESOLVED").when(short, "CONTINUATION_REQUIRED").otherwise("PASS"),
    }).drop("_material")


def assurance_chain(decisions: DataFrame, extras: DataFrame, by: str = "project_id") -> DataFrame:
    """Four layers; a failed lower layer blocks every higher one.

    decisions(by, gate, decision), one row per gate; extras(by, verifier_decision, card_valid).
    """
    gates = decisions.groupBy(by).agg(*[
        F.max(F.when(F.col("gate") == g, F.col("decision"))).alias(f"g{g}") for g in (0, 1, 2, 3)])
    rows = extras.join(gates, by, "left")

    def ok(name: str) -> Column:
        return F.coalesce(F.col(name) == "PASS", F.lit(False))

    one = ok("g0")
    two = one & ok("g1") & ok("g2")
    three = two & ok("g3") & ok("verifier_decision")
    four = three & F.coalesce("card_valid", F.lit(False))

    def layer(passed: Column, below: Column) -> Column:
        return F.when(passed, "PASS").when(~below, "BLOCKED_LOWER_LAYER").otherwise("FAIL")

    layers = {
        "layer1": F.when(one, "PASS").otherwise(F.coalesce("g0", F.lit("FAIL_DATA_NOT_READY"))),
        "layer2": layer(two, one), "layer3": layer(three, two), "layer4": layer(four, three),
    }
    out = rows.select(by, *[c.alias(k) for k, c in layers.items()])
    return out.withColumn("overall_status", F.when(F.col("layer1") != "PASS", F.col("layer1")).when(
        F.col("layer2") != "PASS", F.col("layer2")).when(F.col("layer3") != "PASS", F.col("layer3")).otherwise(F.col("layer4")))


def _blank(column: Column) -> Column:
    return F.trim(F.coalesce(column.cast("string"), F.lit(""))) == ""


def figure_integrity(figures: DataFrame) -> DataFrame:
    missing = F.array_compact(F.array(
        F.when(_blank(F.col("x_axis")) | _blank(F.col("y_axis")), "axis_label"), F.when(_blank(F.col("units")), "units"),
        F.when(_blank(F.col("source_generation")), "source_generation")))
    return figures.withColumn("missing_elements", missing).withColumn(
        "status", F.when(F.size("missing_elements") == 0, "PASS").otherwise("FAIL_FIGURE_INTEGRITY"))


def table_integrity(cells: DataFrame, tables: DataFrame, by: str = "table_id") -> DataFrame:
    """cells(by, row_index, value), tables(by, header_count, source_generation)."""
    per = cells.groupBy(by, "row_index").agg(F.count_if(_blank(F.col("value"))).alias("_e")).groupBy(by).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("_e").alias("empty_cell_count"))
    joined = tables.join(per, by, "left").fillna(0, ["row_count", "empty_cell_count"])
    good = (F.col("header_count") > 0) & (F.col("row_count") > 0) & ~_blank(F.col("source_generation")) & (
        F.col("empty_cell_count") == 0)
    return joined.withColumn("status", F.when(good, "PASS").otherwise("FAIL_TABLE_INTEGRITY"))


# Rating scale and the dimensions of a candidate move.
RATING_SCALE = {"NONE": 0, "LOW": 1, "MODERATE": 2, "HIGH": 3, "VERY_HIGH": 4}
BENEFITS = (
    "information_gain", "rival_discrimination", "falsification_value", "evidence_quality", "dependency_unlocking",
    "reversibility", "reproducibility", "honest_outcome_potential",
)
BURDENS = ("risk", "cost", "time", "user_burden")


def _rating(name: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RATING_SCALE.items() for x in pair])
    return F.try_element_at(table, F.col(name))


def move_scores(moves: DataFrame) -> DataFrame:
    benefit = sum((_rating(n) for n in BENEFITS), F.lit(0))
    burden = sum((_rating(n) for n in BURDENS), F.lit(0))
    return moves.withColumns({"benefit_ordinal": benefit, "burden_ordinal": burden}).withColumn(
        "net_ordinal", F.col("benefit_ordinal") - F.col("burden_ordinal"))


def move_order() -> list[Column]:
    return [
        F.col("net_ordinal").desc(), _rating("falsification_value").desc(), _rating("dependency_unlocking").desc(),
        _rating("evidence_quality").desc(), _rating("risk").asc(), _rating("user_burden").asc(), _rating("time").asc(),
        _rating("cost").asc(), F.col("move_id").cast("string").asc(),
    ]


def rank_moves(moves: DataFrame) -> DataFrame:
    """All moves with their rank in the nine-part order; ranks come from a range-partitioned
    sort with per-partition offsets, so the ranking is not done in one task."""
    from plumbline.operators.digest import with_positions

    ranked = with_positions(move_scores(moves), move_order(), "_place")
    return ranked.withColumn("rank", F.col("_place") + 1).drop("_place")


# The seven checks of a claimed external blocker.
BLOCKER_CHECKS = (
    "VERIFY_REQUIREMENT",
    "SEARCH_DECLARED_BOUNDARY",
    "TEST_SAFE_ALTERNATIVE",
    "TEST_NARROWER_SCOPE",
    "TEST_SUBSTITUTE_EVIDENCE",
    "COMPLETE_SAFE_SCAFFOLD",
    "NO_PATH_CHALLENGE",
)


def blocker_status(checks: DataFrame, requirements: DataFrame, by: str = "blocker_id") -> DataFrame:
    """checks(by, check_id, outcome and, if there, evidence_ref_ids), requirements(by, requirement_count).

    Tells which checks are missing, in their order, and all evidence that the checks name. A blocker has at most one row per check.
    """
    first = BLOCKER_CHECKS[0]
    other = F.col("check_id") != first
    none = F.expr("cast(array() as array<string>)")
    refs = F.coalesce("evidence_ref_ids", none) if "evidence_ref_ids" in checks.columns else none
    per = checks.groupBy(by).agg(
        F.max(F.when(~other, F.col("outcome"))).alias("_req"),
        F.count_if(other & (F.col("outcome") == "PATH_FOUND")).alias("_found"),
        F.count_if(other & (F.col("outcome") != "NO_PATH")).alias("_not_closed"),
        F.count_if(other).alias("_challenges"),
        F.collect_set(F.when(F.col("outcome").isin("NOT_RUN", "INCONCLUSIVE"), F.col("check_id"))).alias("_open"),
        F.collect_set(F.when(F.col("outcome") == "NOT_APPLICABLE", F.col("check_id"))).alias("_na"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(refs)))).alias("evidence_ref_ids"),
    )
    joined = requirements.join(per, by, "left")
    needed = F.col("requirement_count") > 0
    status = (
        F.when(~needed, "REQUIREMENT_NOT_APPLICABLE")
        .when(~F.col("_req").eqNullSafe(F.lit("REQUIREMENT_CONFIRMED")), "BLOCKER_NOT_EVIDENCED")
        .when(F.col("_found") > 0, "PATH_AVAILABLE")
        .when((F.col("_not_closed") == 0) & (F.col("_challenges") == len(BLOCKER_CHECKS) - 1), "EVIDENCED_EXTERNAL_BLOCKER")
        .otherwise("BLOCKER_NOT_EVIDENCED")
    )
    lacking = F.concat(F.coalesce("_open", none), F.when(needed, F.coalesce("_na", none)).otherwise(none))
    missing = F.array_intersect(F.array(*[F.lit(c) for c in BLOCKER_CHECKS]), lacking)
    return joined.select(
        by, status.alias("status"), F.size(missing).cast("long").alias("missing_check_count"), missing.alias("missing_check_ids"),
        F.coalesce("evidence_ref_ids", none).alias("evidence_ref_ids"))


def detector_scores(expected: DataFrame, observed: DataFrame, by: str = "detector", key: str = "issue_id") -> DataFrame:
    """Precision, recall and F1 per detector; expected(key) is shared by all detectors.

    Undefined ratios are NULL.
    """
    truth = expected.select(key).distinct()
    total = truth.agg(F.count(F.lit(1)).alias("expected_count"))
    seen = observed.filter(F.trim(F.col(key).cast("string")) != "").select(by, key).distinct()
    marked = seen.join(truth.withColumn("_hit", F.lit(True)), key, "left")
    per = marked.groupBy(by).agg(
        F.count(F.lit(1)).alias("observed_count"), F.count_if(F.col("_hit").isNotNull()).alias("true_positive_count"))
    joined = per.withColumn("expected_count", total.scalar())
    tp, n_obs, n_exp = F.col("true_positive_count"), F.col("observed_count"), F.col("expected_count")
    precision, recall = F.try_divide(tp, n_obs), F.try_divide(tp, n_exp)
    return joined.withColumns({
        "false_positive_count": n_obs - tp, "false_negative_count": n_exp - tp, "precision": precision, "recall": recall,
    }).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def answer_key_errors(issues: DataFrame, scorecard: DataFrame, expected_issues: int, points: int = 100) -> DataFrame:
    """Failed structural checks of an answer key."""
    a = issues.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"),
                   F.count_if(_blank(F.col("title")) | _blank(F.col("evidence"))).alias("b"))
    b = scorecard.agg(F.sum("points").alias("p"), F.count_if(_blank(F.col("rule"))).alias("r"))
    left = a.select(F.explode(F.array_compact(F.array(
        F.when(F.col("n") != expected_issues, "ISSUE_COUNT"), F.when(F.col("d") != F.col("n"), "ISSUE_ID_REPEATED"),
        F.when(F.col("b") > 0, "ISSUE_INCOMPLETE")))).alias("problem"))
    right = b.select(F.explode(F.array_compact(F.array(
        F.when(F.coalesce("p", F.lit(0)) != points, "SCORECARD_POINTS"), F.when(F.col("r") > 0, "SCORECARD_RULE")))).alias(
        "problem"))
    return left.unionByName(right)


def claim_traces(claims: DataFrame, evidence: DataFrame, steps: DataFrame, records: DataFrame, tasks: int | None = None) -> DataFrame:
    """Trace rows (claim_id, level, level_order, item, detail) from a claim to its acquisition.

    claims(claim_id, statement), evidence(claim_id, id, artifact_path, source_locator),
    steps(claim_id, step_index, step_name, output_sha256), records(claim_id, records_sha256). Claims meet their steps and
    records in as many tasks as the rows need; a caller that knows the number saves the counts.
    """
    tasks = tasks or max(tasks_for(claims), tasks_for(steps), tasks_for(records))

    def level(rows: DataFrame, order: int, name: str, item: Column, detail: Column) -> DataFrame:
        return rows.select("claim_id", F.lit(order).alias("level_order"), F.lit(name).alias("level"),
                           item.cast("string").alias("item"), detail.cast("string").alias("detail"))

    none = steps.select("claim_id").repartition(tasks, "claim_id").distinct()
    ids = claims.select("claim_id").repartition(tasks, "claim_id")
    identity = ids.join(none.hint("shuffle_hash"), "claim_id", "left_anti")
    bound = ids.join(records.repartition(tasks, "claim_id").hint("merge"), "claim_id", "left")
    status = F.when(F.coalesce("records_sha256", F.lit("")) != "", "data_readiness_pass").otherwise("unverified")
    return (
        level(claims, 1, "claim", F.col("claim_id"), F.col("statement"))
        .unionByName(level(evidence, 2, "result", F.col("id"), F.concat_ws("#", "artifact_path", "source_locator")))
        .unionByName(level(bound, 3, "record", F.lit("records"), F.coalesce("records_sha256", F.lit(""))))
        .unionByName(level(steps, 4, "transformation", F.col("step_index"), F.concat_ws("#", "step_name", "output_sha256")))
        .unionByName(level(identity, 4, "transformation", F.lit("0"), F.lit("identity_sort")))
        .unionByName(level(bound, 5, "acquisition", F.lit("acquisition"), status))
    )


def trace_summary(traces: DataFrame, tasks: int | None = None) -> DataFrame:
    """Completeness per claim: bound records and at least one result."""
    marks = traces.select("claim_id", ((F.col("level") == "record") & (F.col("detail") != "")).alias("_record"), (F.col("level") == "result").alias("_result"))
    return marks.repartition(tasks or tasks_for(traces), "claim_id").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("level_rows"), (F.bool_or("_record") & F.bool_or("_result")).alias("complete_to_source"))


def trace_digest(traces: DataFrame) -> DataFrame:
    """Digest of all trace rows in (claim, level, item) order."""
    from plumbline.operators.digest import with_positions

    hashed = traces.withColumn("record_sha256", record_hash(traces))
    order = [F.col("claim_id"), F.col("level_order"), F.col("item"), F.col("record_sha256")]
    return order_digest(with_positions(hashed, order, "ordinal"), "ordinal", "record_sha256")


def clean_star_summary(outcomes: DataFrame, participants: DataFrame, measures: list[str], subgroup: Column,
                       week: int, drop: Column, fixes: dict[str, Column]) -> DataFrame:
    """Cleaned star join: drop marked rows, repair ids and units, join to the dimension, then
    grouped means with NULL skipped, for everyone and for a subgroup (means rounded to 4)."""
    cleaned = outcomes.filter(~F.coalesce(drop, F.lit(False))).withColumns(fixes)
    joined = cleaned.filter(F.col("week") == week).join(participants, "participant_id")
    means = [F.round(F.avg(m), 4).alias(f"{m}_mean") for m in measures]
    parts = [
        joined.groupBy("condition").agg(F.count(F.lit(1)).alias("rows"), *means).withColumn("population", F.lit("all")),
        joined.filter(subgroup).groupBy("condition").agg(F.count(F.lit(1)).alias("rows"), *means).withColumn(
            "population", F.lit("subgroup")),
    ]
    return parts[0].unionByName(parts[1])


