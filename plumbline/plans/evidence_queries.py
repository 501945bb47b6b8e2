"""Strength, floors, uncertainty, measurements, ranking, scores and assurance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evidence, gates
from plumbline.plans.lineage_queries import lineitem_evidence
from plumbline.plans.registry import query, sql_hash, table
from plumbline.plans.rule_queries import _LATEST, _closing_sql, order_decisions, wording

_EVSQL = "ev as (select l_orderkey as c, l_partkey as a, l_suppkey as l, l_returnflag <> 'R' as prim from lineitem)"


@query("strength_vector", f"""with {_EVSQL}, s as (select c, a, l, count(*) as n, count_if(prim) as p from ev group by 1,2,3),
x as (select c, count(*) as u, count_if(p > 0) as up, sum(n) - count(*) as sh, sum(p) as pr, sum(n) - sum(p) as inh from s group by 1),
b as (select distinct l_orderkey as c from lineitem where l_linenumber = 7 and l_returnflag = 'R'),
v as (select o_orderkey as claim_id, case when coalesce(u,0) >= 2 and coalesce(sh,0) = 0 then 'STRONG' when coalesce(u,0) >= 1 then 'MODERATE' else 'WEAK' end as independence,
 case when coalesce(pr,0) > 0 and coalesce(inh,0) = 0 then 'STRONG' when coalesce(pr,0) > 0 then 'MODERATE' else 'WEAK' end as directness,
 case when o_orderpriority = '1-URGENT' then 'STRONG' else 'MODERATE' end as precision_score, case when o_orderstatus = 'F' then 'STRONG' else 'WEAK' end as reproducibility,
 case when b.c is not null then 'WEAK' else 'STRONG' end as integrity, coalesce(sh,0)::bigint as shared_lineage_count, coalesce(u,0)::bigint as unique_sources, coalesce(up,0)::bigint as unique_primary_sources
 from orders left join x on x.c = o_orderkey left join b on b.c = o_orderkey)
select *, case when 'WEAK' in (independence, directness, precision_score, reproducibility, integrity) then 'WEAK' when 'MODERATE' in (independence, directness, precision_score, reproducibility, integrity) then 'MODERATE' else 'STRONG' end as overall_status from v""")
def strength_vector(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    claims = o.select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderpriority") == "1-URGENT").alias("has_uncertainty"))
    receipts = o.select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("status"))
    findings = table(spark, d, "lineitem").filter("l_linenumber = 7").select(
        F.col("l_orderkey").alias("claim_id"), F.lit("warning").alias("severity"), F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("WARN").alias("status"))
    return evidence.strength_vector(lineitem_evidence(spark, d), claims, receipts, findings)


def _class_sql(x: str, whole: bool) -> str:
    def hit(word: str) -> str:
        return rf"regexp_matches({x}, '(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])')" if whole else f"contains({x}, '{word}')"

    cases = " ".join("when " + " or ".join(hit(w) for w in words) + f" then '{name}'" for name, words in evidence.CLAIM_KEYWORDS.items())
    return f"case {cases} else 'descriptive' end"


@query("claim_classes", f"with {_closing_sql()} select pointer, {_class_sql('lower(body)', False)} as by_substring, {_class_sql('lower(body)', True)} as by_word from w")
def claim_classes(spark: SparkSession, d: str) -> DataFrame:
    return wording(spark, d).select("pointer", evidence.claim_class(F.col("body")).alias("by_substring"),
                                    evidence.claim_class(F.col("body"), word_boundary=True).alias("by_word"))


@query("evidence_floor", """
with e as (select l_orderkey as c, bool_or(l_returnflag='A') as p, bool_or(l_returnflag='N') as k, bool_or(l_returnflag='R') as f, bool_or(l_linenumber=7) as s from lineitem group by 1),
n as (select c, count(*) as n from (select distinct l_orderkey as c, l_partkey, l_suppkey from lineitem where l_linestatus='O') group by 1),
q as (select o_orderkey as claim_id, case o_orderpriority when '1-URGENT' then 'causal' when '2-HIGH' then 'associational' when '3-MEDIUM' then 'mechanistic' when '5-LOW' then 'descriptive' else 'measurement' end as claim_class,
 coalesce(p,false) as p, coalesce(k,false) as k, coalesce(f,false) as f, coalesce(s,false) as s, coalesce(n.n,0) as n, o_orderstatus='O' as nocmd from orders left join e on e.c=o_orderkey left join n on n.c=o_orderkey),
m as (select *, list_filter([case when claim_class='measurement' then 'calibration_record' end, case when claim_class in ('causal','associational') and not k then 'control_comparison' end,
  case when claim_class='causal' and not f then 'falsification_test' end, case when not p then 'primary' end, case when claim_class='mechanistic' and not s then 'step_verification' end], lambda z: z is not null) as miss,
  nocmd and claim_class <> 'descriptive' as lack, case claim_class when 'causal' then 2 else 1 end as need from q)
select claim_id, claim_class, case when len(miss)=0 and not lack and n >= need then claim_class when claim_class='causal' then 'associational' when claim_class='associational' then 'descriptive' else claim_class end as effective_class,
 len(miss)=0 and not lack and n >= need as met, array_to_string(miss,';') as missing_roles, lack as lacks_reproducibility, n::bigint as independent_sources_count, need as minimum_sources_required,
 not (len(miss)=0 and not lack and n >= need) and claim_class in ('causal','associational') as narrowed from m""")
def evidence_floor(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "causal").when(F.col("o_orderpriority") == "2-HIGH", "associational").when(
        F.col("o_orderpriority") == "3-MEDIUM", "mechanistic").when(F.col("o_orderpriority") == "5-LOW", "descriptive").otherwise("measurement")
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), kind.alias("claim_class"),
                                              F.when(F.col("o_orderstatus") != "O", "make").alias("reproducibility_command"))
    role = F.when(F.col("l_returnflag") == "A", "Primary").when(F.col("l_returnflag") == "N", "control_comparison").otherwise("falsification_test")
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("claim_id"), role.alias("role"), F.col("l_partkey").cast("string").alias("artifact_path"),
                     F.col("l_suppkey").cast("string").alias("source_locator"), (F.col("l_linestatus") == "O").alias("primary"))
    steps = li.filter("l_linenumber = 7").select(
        F.col("l_orderkey").alias("claim_id"), F.lit("step_verification").alias("role"), F.col("l_partkey").cast("string").alias("artifact_path"),
        F.col("l_suppkey").cast("string").alias("source_locator"), F.lit(False).alias("primary"))
    return evidence.evidence_floor(claims, rows.unionByName(steps)).withColumn("missing_roles", F.array_join("missing_roles", ";"))


@query("uncertainty_budget", """
with u as (select user_id, sqrt(sum((value/20000)*(value/20000))) as u, count(*) as n, count_if(event_type='error' and value > 40) as q from events group by 1)
select user_id, round(u, 9) as combined, n::bigint as known_components, q::bigint as unquantified_sources,
 case when q > 0 then 'unquantified' when u < 0.05 then 'high' when u < 0.2 then 'moderate' else 'low' end as certainty_ceiling, q > 0 or u >= 0.2 as blocks_strong_claim from u""")
def uncertainty_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("u", F.col("value") / 20000)
    out = evidence.uncertainty_budget(e, "user_id", "u", (F.col("event_type") == "error") & (F.col("value") > 40))
    return out.select("user_id", F.round("combined_standard_uncertainty", 9).alias("combined"), "known_components", "unquantified_sources",
                      "certainty_ceiling", "blocks_strong_claim")


@query("confidence_refusals", """
select event_id, case when not (value*3 between 0 and 100) then 'CONFIDENCE_OUT_OF_RANGE' when event_type <> 'click' then 'UNCALIBRATED_CONFIDENCE_REFUSED' end as refusal from events""")
def confidence_refusals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", evidence.confidence_refusal(F.col("value") * 3, F.col("event_type") == "click").alias("refusal"))


_UNIT = {"view": " Seconds", "click": "percent", "purchase": "USD ", "signup": "m/s", "error": "widgets"}


def measurements(spark: SparkSession, d: str) -> DataFrame:
    unit = F.create_map(*[F.lit(x) for p in _UNIT.items() for x in p])[F.col("event_type")]
    rows = table(spark, d, "events").select(
        "event_id", "value", unit.alias("unit"), F.when(F.col("user_id") > 50, "UTC").otherwise("CET").alias("timezone"))
    return evidence.measurement_records(rows)


_MEAS = """m as (select event_id, value, case event_type when 'view' then 'seconds' when 'click' then 'percent' when 'purchase' then 'usd' when 'signup' then 'm/s' else 'widgets' end as unit,
 case event_type when 'view' then 'time' when 'click' then 'ratio' when 'purchase' then 'currency' else 'custom' end as dimension, case when user_id > 50 then 'UTC' else 'CET' end as timezone from events)"""


@query("measurement_records", f"""with {_MEAS}
select event_id, unit, dimension, {sql_hash({'event_id': 'n', 'value': 'n', 'unit': 's', 'timezone': 's', 'dimension': 's'})} as sha256, case when unit = 'm/s' then 'MEASUREMENT_INVALID_UNIT' end as refusal from m""")
def measurement_records(spark: SparkSession, d: str) -> DataFrame:
    return measurements(spark, d).select("event_id", "unit", "dimension", "sha256", "refusal")


@query("measurement_compatibility", f"""with {_MEAS}
select a.event_id, a.unit <> b.unit as unit_mismatch, a.dimension <> b.dimension as dimension_mismatch, a.timezone <> b.timezone and (a.dimension='time' or b.dimension='time') as timezone_mismatch,
 case when a.dimension <> b.dimension then 'DIMENSION' when a.unit <> b.unit then 'UNIT' else '' end || case when a.timezone <> b.timezone and (a.dimension='time' or b.dimension='time') then case when a.unit <> b.unit then ';TIMEZONE' else 'TIMEZONE' end else '' end as errors,
 case when a.unit <> b.unit or a.timezone <> b.timezone and (a.dimension='time' or b.dimension='time') then 'FAIL_MEASUREMENT_MISMATCH' else 'PASS' end as status
from m a join m b on b.event_id = a.event_id + 1""")
def measurement_compatibility(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d)
    a = m.select("event_id", *[F.col(c).alias("a_" + c) for c in ("unit", "dimension", "timezone")])
    b = m.select((F.col("event_id") - 1).alias("event_id"), *[F.col(c).alias("b_" + c) for c in ("unit", "dimension", "timezone")])
    return evidence.compatibility(a.join(b, "event_id")).select(
        "event_id", "unit_mismatch", "dimension_mismatch", "timezone_mismatch", F.array_join("errors", ";").alias("errors"), "status")


@query("discrepancies", """
with p as (select a.event_id, a.value as e, b.value as c, a.event_type as et, b.event_type as ct from events a join events b on b.event_id = a.event_id + 1),
x as (select *, case when et = 'error' then case when et = ct then 0.0 else 1.0 end else abs(e - c) end as df from p)
select event_id, round(df, 9) as difference, df > 5.0 or (df > 0 and ct = 'click') as is_material, case when df > 5.0 or (df > 0 and ct='click') then 'FAIL_MATERIAL_DISCREPANCY' when df > 0 then 'IMMATERIAL_RECORDED' else 'PASS_EXACT' end as status from x""")
def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.select("event_id", F.col("value").alias("v"), F.col("event_type").alias("t"))
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("v2"), F.col("event_type").alias("t2"))
    text = F.col("t") == "error"
    pairs = a.join(b, "event_id").withColumns({
        "expected": F.when(text, F.col("t")).otherwise(F.col("v").cast("string")), "actual": F.when(text, F.col("t2")).otherwise(F.col("v2").cast("string"))})
    out = evidence.discrepancies(pairs, "expected", "actual", 5.0, F.col("t2") == "click")
    return out.select("event_id", F.round("difference", 9).alias("difference"), "is_material", "status")


_DEPTH = """t as (select o_orderkey as claim_id, o_orderpriority='1-URGENT' as h, o_totalprice between 249000 and 251000 as n, o_orderstatus='P' as c, o_orderkey not in (select l_orderkey from lineitem) as w from orders),
q as (select *, case when h or n then 'microscopic' when c or w then 'deep' else 'standard' end as required_depth from t)"""


def depth_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_x", F.lit(1))
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("claim_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_high_stakes"),
        F.col("o_totalprice").between(249000, 251000).alias("is_near_threshold"), (F.col("o_orderstatus") == "P").alias("has_conflicting_observations"),
        F.col("_x").isNull().alias("is_weakly_corroborated"))
    return evidence.required_depth(rows)


@query("required_depth", f"""with {_DEPTH}
select claim_id, concat_ws(';', case when h then 'high_stakes_claim' end, case when n then 'near_decision_boundary' end, case when c then 'conflicting_observations' end, case when w then 'weakly_corroborated' end) as triggers_fired, required_depth from q""")
def required_depth(spark: SparkSession, d: str) -> DataFrame:
    return depth_rows(spark, d).select("claim_id", F.array_join("triggers_fired", ";").alias("triggers_fired"), "required_depth")


@query("stopping_rule", f"""with {_DEPTH}, m as (select l_orderkey as k, bool_or(l_returnflag='R' and l_linenumber = 1) as mat from lineitem group by 1)
select claim_id, case when coalesce(mat,false) then 'DEEPEN_REVIEW' when c and required_depth <> 'deep' then 'EMIT_CONTINUATION_PACKET' else 'SEAL_DEPTH_RECEIPT' end as action,
 case when coalesce(mat,false) then 'FAIL_MATERIAL_DISCREPANCY_UNRESOLVED' when c and required_depth <> 'deep' then 'CONTINUATION_REQUIRED' else 'PASS' end as status from q left join m on k = claim_id""")
def stopping_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = depth_rows(spark, d).select("claim_id", F.lit("deep").alias("current_depth"), "required_depth", F.col("has_conflicting_observations").alias("resources_exhausted"))
    found = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("is_material"))
    return evidence.stopping_rule(rows, found).select("claim_id", "action", "status")


@query("assurance_chain", f"""with {_LATEST}, g as (select project_id, max(case when gate=0 then decision end) as g0, max(case when gate=1 then decision end) as g1, max(case when gate=2 then decision end) as g2, max(case when gate=3 then decision end) as g3 from n group by 1),
p as (select c_custkey as project_id, coalesce(g0='PASS',false) as a, coalesce(g0='PASS' and g1='PASS' and g2='PASS',false) as b, coalesce(g0='PASS' and g1='PASS' and g2='PASS' and g3='PASS' and c_acctbal > 0,false) as c,
 coalesce(g0='PASS' and g1='PASS' and g2='PASS' and g3='PASS' and c_acctbal > 0 and c_mktsegment <> 'BUILDING',false) as e, coalesce(g0,'FAIL_DATA_NOT_READY') as z from customer left join g on g.project_id = c_custkey),
l as (select project_id, case when a then 'PASS' else z end as layer1, case when b then 'PASS' when not a then 'BLOCKED_LOWER_LAYER' else 'FAIL' end as layer2, case when c then 'PASS' when not b then 'BLOCKED_LOWER_LAYER' else 'FAIL' end as layer3, case when e then 'PASS' when not c then 'BLOCKED_LOWER_LAYER' else 'FAIL' end as layer4 from p)
select *, case when layer1 <> 'PASS' then layer1 when layer2 <> 'PASS' then layer2 when layer3 <> 'PASS' then layer3 else layer4 end as overall_status from l""")
def assurance_chain(spark: SparkSession, d: str) -> DataFrame:
    extras = table(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"), F.when(F.col("c_acctbal") > 0, "PASS").alias("verifier_decision"), (F.col("c_mktsegment") != "BUILDING").alias("card_valid"))
    return evidence.assurance_chain(gates.latest_decisions(order_decisions(spark, d)), extras)


@query("figure_integrity", """
select p_partkey, concat_ws(';', case when p_type='PROMO' or p_size = 3 then 'axis_label' end, case when p_size > 40 then 'units' end, case when p_type='SMALL' then 'source_generation' end) as missing_elements,
 case when p_type in ('PROMO','SMALL') or p_size = 3 or p_size > 40 then 'FAIL_FIGURE_INTEGRITY' else 'PASS' end as status from part""")
def figure_integrity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_name")).alias("x_axis"), F.when(F.col("p_size") == 3, " ").otherwise(F.col("p_name")).alias("y_axis"),
        F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("units"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("source_generation"))
    return evidence.figure_integrity(p).select("p_partkey", F.array_join("missing_elements", ";").alias("missing_elements"), "status")


@query("table_integrity", """
with c as (select l_orderkey as k, count(distinct l_linenumber) as n, count_if(l_returnflag='R' and l_linenumber=7) as e from lineitem group by 1)
select o_orderkey as table_id, coalesce(n,0)::bigint as row_count, coalesce(e,0)::bigint as empty_cell_count,
 case when coalesce(n,0) > 0 and coalesce(e,0) = 0 and o_orderstatus <> 'P' then 'PASS' else 'FAIL_TABLE_INTEGRITY' end as status from orders left join c on k = o_orderkey""")
def table_integrity(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_index"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), " ").otherwise(F.col("l_returnflag")).alias("value"))
    tables = table(spark, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.lit(3).alias("header_count"),
                                              F.when(F.col("o_orderstatus") != "P", "s").alias("source_generation"))
    return evidence.table_integrity(cells, tables).select("table_id", "row_count", "empty_cell_count", "status")


_SCALE = list(evidence.RATING_SCALE)
_DIMENSIONS = evidence.BENEFITS + evidence.BURDENS


@query("move_ranking", "with r as (select p_partkey, " + ", ".join(f"((p_size + {i} * p_partkey) % 5)::int as {n}" for i, n in enumerate(_DIMENSIONS)) + " from part), s as (select *, "
       + " + ".join(evidence.BENEFITS) + " as b, " + " + ".join(evidence.BURDENS) + """ as u from r)
select p_partkey as move_id, b as benefit_ordinal, u as burden_ordinal, b - u as net_ordinal, row_number() over (order by b - u desc, falsification_value desc, dependency_unlocking desc, evidence_quality desc,
 risk, user_burden, time, cost, p_partkey::varchar)::bigint as rank from s""")
def move_ranking(spark: SparkSession, d: str) -> DataFrame:
    scale = F.array(*[F.lit(s) for s in _SCALE])
    moves = table(spark, d, "part").select(F.col("p_partkey").alias("move_id"), *[
        F.element_at(scale, ((F.col("p_size") + i * F.col("p_partkey")) % 5).cast("int") + 1).alias(n) for i, n in enumerate(_DIMENSIONS)])
    return evidence.rank_moves(moves).select("move_id", "benefit_ordinal", "burden_ordinal", "net_ordinal", "rank")


_BLOCKER_NAMES = "[" + ", ".join(f"'{c}'" for c in evidence.BLOCKER_CHECKS) + "]"


@query("blocker_status", f"""
with c as (select l_orderkey as k, l_linenumber as n, {_BLOCKER_NAMES}[l_linenumber] as name, max(case when l_linenumber = 1 then case l_returnflag when 'A' then 'REQUIREMENT_CONFIRMED' when 'N' then 'NOT_RUN' else 'INCONCLUSIVE' end
  else case when l_returnflag = 'A' and l_linestatus = 'O' and l_quantity > 45 then 'PATH_FOUND' when l_returnflag = 'N' then 'NO_PATH' when l_quantity > 25 then 'NO_PATH' else 'NOT_APPLICABLE' end end) as o from lineitem group by 1,2),
g as (select k, max(case when n = 1 then o end) as rq, count_if(n > 1 and o='PATH_FOUND') as f, count_if(n > 1 and o <> 'NO_PATH') as nc, count_if(n > 1) as ch,
  string_agg(name, ';' order by n) filter (o in ('NOT_RUN','INCONCLUSIVE')) as op, string_agg(name, ';' order by n) filter (o in ('NOT_RUN','INCONCLUSIVE','NOT_APPLICABLE')) as na from c group by 1),
e as (select l_orderkey as k, string_agg(distinct 'p' || l_partkey, ';' order by 'p' || l_partkey) as refs from lineitem group by 1),
r as (select o_orderkey as blocker_id, case when o_orderstatus = 'P' then 'REQUIREMENT_NOT_APPLICABLE' when rq is distinct from 'REQUIREMENT_CONFIRMED' then 'BLOCKER_NOT_EVIDENCED' when f > 0 then 'PATH_AVAILABLE' when nc = 0 and ch = 6 then 'EVIDENCED_EXTERNAL_BLOCKER' else 'BLOCKER_NOT_EVIDENCED' end as status,
 coalesce(case when o_orderstatus = 'P' then op else na end, '') as missing_check_ids, coalesce(refs, '') as evidence_ref_ids from orders left join g on k = o_orderkey left join e on e.k = o_orderkey)
select *, case when missing_check_ids = '' then 0 else len(string_split(missing_check_ids, ';')) end::bigint as missing_check_count from r""")
def blocker_status(spark: SparkSession, d: str) -> DataFrame:
    f, first = F.col("l_returnflag"), F.col("l_linenumber") == 1
    outcome = F.when(first, F.when(f == "A", "REQUIREMENT_CONFIRMED").when(f == "N", "NOT_RUN").otherwise("INCONCLUSIVE")).when(
        (f == "A") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), "PATH_FOUND").when(f == "N", "NO_PATH").when(
        F.col("l_quantity") > 25, "NO_PATH").otherwise("NOT_APPLICABLE")
    names = F.array(*[F.lit(c) for c in evidence.BLOCKER_CHECKS])
    checks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("blocker_id"), F.element_at(names, F.col("l_linenumber")).alias("check_id")).agg(
        F.max(outcome).alias("outcome"), F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("evidence_ref_ids"))
    needs = table(spark, d, "orders").select(F.col("o_orderkey").alias("blocker_id"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("requirement_count"))
    found = evidence.blocker_status(checks, needs)
    return found.withColumns({c: F.array_join(c, ";") for c in ("missing_check_ids", "evidence_ref_ids")})


@query("detector_scores", """
with t as (select doc_id from labels where toxic = 1), o as (select distinct lang as detector, d.doc_id from documents d join labels l on l.doc_id = d.doc_id where quality = 1
 union select 'all', doc_id from labels union select 'toxic', doc_id from labels where toxic = 1),
p as (select detector, count(*) as n, count(t.doc_id) as tp from o left join t on t.doc_id = o.doc_id group by 1), e as (select count(*) as m from t)
select detector, n::bigint as observed_count, tp::bigint as true_positive_count, m::bigint as expected_count, (n - tp)::bigint as false_positive_count, (m - tp)::bigint as false_negative_count,
 round(tp / n, 9) as precision, round(tp / m, 9) as recall, round(case when tp > 0 then 2 * (tp/n) * (tp/m) / (tp/n + tp/m) end, 9) as f1 from p, e""")
def detector_scores(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    by_lang = table(spark, d, "documents").join(labels.filter("quality = 1"), "doc_id").select(F.col("lang").alias("detector"), "doc_id")
    observed = by_lang.unionByName(labels.select(F.lit("all").alias("detector"), "doc_id")).unionByName(
        labels.filter("toxic = 1").select(F.lit("toxic").alias("detector"), "doc_id"))
    out = evidence.detector_scores(labels.filter("toxic = 1"), observed, "detector", "doc_id")
    return out.select(*[c for c in out.columns if c not in ("precision", "recall", "f1")], *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("answer_key_errors", """
select 'ISSUE_COUNT' as problem from part having count(*) <> 24 union all select 'ISSUE_ID_REPEATED' from part having count(distinct p_name) <> count(*)
union all select 'SCORECARD_POINTS' from nation having sum(n_regionkey) <> 100""")
def answer_key_errors(spark: SparkSession, d: str) -> DataFrame:
    issues = table(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_type").alias("title"), F.col("p_brand").alias("evidence"))
    card = table(spark, d, "nation").select(F.col("n_regionkey").alias("points"), F.col("n_name").alias("rule"))
    return evidence.answer_key_errors(issues, card, 24)


@query("clean_star_summary", """
with o as (select case when o_custkey = 7 then 8 else o_custkey end as c, o_orderdate, case when o_orderpriority = '2-HIGH' then o_totalprice / 10 else o_totalprice end as p from orders where not (o_orderpriority='5-LOW' and o_orderstatus='P')),
j as (select c_mktsegment as condition, p, c_acctbal from o join customer on c_custkey = c where year(o_orderdate) = 1997)
select condition, count(*)::bigint as rows, round(avg(p),4) as price_mean, 'all' as population from j group by 1 union all select condition, count(*), round(avg(p),4), 'subgroup' from j where c_acctbal < 1000 group by 1""")
def clean_star_summary(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("participant_id"), F.year("o_orderdate").alias("week"), F.col("o_totalprice").alias("price"), "o_orderpriority", "o_orderstatus")
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("participant_id"), F.col("c_mktsegment").alias("condition"), "c_acctbal")
    return evidence.clean_star_summary(
        o, who, ["price"], F.col("c_acctbal") < 1000, 1997, (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"),
        {"participant_id": F.when(F.col("participant_id") == 7, 8).otherwise(F.col("participant_id")),
         "price": F.when(F.col("o_orderpriority") == "2-HIGH", F.col("price") / 10).otherwise(F.col("price"))})
