"""Claim, evidence and method rules over entities taken from the given tables.

A project is a customer, a claim an order, evidence a line item or part, and wording is
the whole text of documents and conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import contracts, gates, rules
from plumbline.operators import rule_tables as R
from plumbline.plans.registry import query, sql_hash, table
from plumbline.session import tasks_for

_FINDING = "gate, code, severity, status, subject"


def _f(gate: int, code: str, subject: str, source: str, where: str, soft: bool = False) -> str:
    sev, st = ("warning", "WARN") if soft else ("blocker", "FAIL")
    return (f"select {gate} as gate, '{code}' as code, '{sev}' as severity, '{st}' as status, ({subject})::varchar as subject "
            f"from {source} where {where}")


def _union(*parts: str) -> str:
    return "\nunion all ".join(parts)


# ---- wording ----------------------------------------------------------------------------
# Each document gets a closing sentence by language and source, so that every pattern fires
# somewhere; the whole text is scanned.

_CLOSING = {
    "src0": " TODO: replace me.", "src1": " This method is robust and better.", "src2": " The robust result is measured by a threshold.",
    "src3": " It always works, with no exceptions.", "src4": " This is the world's first and unprecedented.",
    "src5": " Obviously the critics are lazy.", "src6": " Everyone knows this, therefore it must be true.",
    "src7": " Experts say so, which proves it.", "src8": " There is no evidence of harm, which means it is safe.",
    "src9": " There are only two possibilities.", "src10": " A dishonest reviewer would object.",
    "src11": " It works because it works.", "src12": " See 10.0000/example for more.", "src13": " Die Lösung ist éTODO gut.",
}


def wording(spark: SparkSession, d: str) -> DataFrame:
    table_ = F.create_map(*[F.lit(x) for p in _CLOSING.items() for x in p])
    closing = F.coalesce(F.try_element_at(table_, F.col("source")), F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pointer"), F.concat("text", closing).alias("body"))


def _closing_sql() -> str:
    cases = " ".join("when '{}' then '{}'".format(k, v.replace("'", "''")) for k, v in _CLOSING.items())
    return f"w as (select doc_id::varchar as pointer, text || case source {cases} else '' end as body from documents)"


_L, _R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _m(words: str) -> str:
    return f"regexp_matches(body, '{_L}({words}){_R}', 'is')".replace("world'?s", "world''?s")


_VAGUE = "better|improved|significant|robust|scalable|effective|efficient|state[- ]of[- ]the[- ]art|good|bad|large|small|normal|obvious"
_WORDING_SQL = "with " + _closing_sql() + "\n" + _union(
    _f(1, "PLACEHOLDER_LANGUAGE", "pointer", "w",
       _m(r"todo|tbd|fixme|lorem\s+ipsum|fill\s+this|replace\s+me|example\s+only")
       + r" or regexp_matches(body, '10\.0000/(replace|example)|<[^>]*(insert|replace)[^>]*>', 'is')"),
    _f(1, "VAGUE_EVALUATIVE_TERM", "pointer", "w",
       _m(_VAGUE) + " and not " + _m("defined as|measured by|threshold|compared with|relative to")),
    _f(1, "UNBOUNDED_CERTAINTY", "pointer", "w",
       _m("always|never|everyone|nobody|all cases|no exceptions|guarantee[sd]?|undeniably|unquestionably|conclusively proves?")
       + r" or regexp_matches(body, '(^|[^\p{L}\p{N}_])100\s*%[\p{L}\p{N}_]', 'is')"),
    _f(1, "GLOBAL_NOVELTY_OVERCLAIM", "pointer", "w",
       _m("first[- ]ever|world'?s first|unprecedented|revolutionary|best in the world|entirely novel|no one has ever")),
    _f(1, "LOADED_FRAMING", "pointer", "w",
       _m("obviously|merely|just|dumb|stupid|lazy|corrupt|fraudulent|fake|agenda|propaganda|common sense")),
    _f(1, "POPULARITY_AS_EVIDENCE", "pointer", "w",
       _m(r"(everyone (knows|agrees?)|most people agree|widely believed|common knowledge)\b.{0,100}\b(therefore|proves?|must be true)")),
    _f(1, "AUTHORITY_AS_PROOF", "pointer", "w", _m(r"(experts say|a famous|the consensus says)\b.{0,100}\b(therefore|proves?)")),
    _f(1, "ABSENCE_AS_PROOF", "pointer", "w", _m(r"no evidence\b.{0,120}\b(therefore|proves?|means)")),
    _f(1, "FALSE_DILEMMA", "pointer", "w",
       _m(r"either\b.{0,100}\bor\b.{0,100}\bno other|only two possibilities|if not .{0,80} then")),
    _f(1, "AD_HOMINEM", "pointer", "w", _m(r"(idiot|stupid|ignorant|dishonest)\s+(reviewer|author|critic|researcher)s?")),
    _f(1, "CIRCULAR_SUPPORT", "pointer", "w", _m("true because it is true|works because it works|valid because it is valid")),
)


@query("wording_findings", _WORDING_SQL)
def wording_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.wording_findings(wording(spark, d), "pointer", "body", "strict")


_TERMS = ", ".join(f"case when regexp_matches(lower(body), '{_L}{t}{_R}') then '{t}' end" for t in sorted(_VAGUE.split("|")))


@query("vague_terms", f"with {_closing_sql()}, t as (select pointer, concat_ws(';', {_TERMS}) as terms from w) select * from t where terms <> ''")
def vague_terms(spark: SparkSession, d: str) -> DataFrame:
    found = wording(spark, d).select("pointer", rules.vague_terms(F.col("body")).alias("t")).filter(F.size("t") > 0)
    return found.select("pointer", F.array_join("t", ";").alias("terms"))


# ---- projects ---------------------------------------------------------------------------


def projects(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    body = F.concat("c_name", F.lit(" "), "c_mktsegment")

    def cut(extra: int) -> Column:
        return F.substring(body, F.lit(1), F.col("c_nationkey") + extra)

    def some(segment: str) -> Column:
        return F.when(F.col("c_mktsegment") == segment, F.array().cast("array<string>")).otherwise(F.array("c_name", "c_mktsegment"))

    return c.select(
        F.col("c_custkey").alias("project_id"), cut(0).alias("question"), cut(6).alias("hypothesis"), cut(2).alias("falsifier"),
        cut(1).alias("neutral_restatement"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.create_map("c_name", "c_mktsegment")).alias("operational_definitions"),
        some("MACHINERY").alias("success_criteria"), some("FURNITURE").alias("competing_frames"), some("HOUSEHOLD").alias("scope_boundaries"),
        F.when(F.col("c_acctbal") < 0, "in_progress").otherwise("complete").alias("novelty_status"),
        F.when(F.col("c_nationkey") < 3, "2024-02-31").otherwise("2024-02-28").alias("novelty_search_date"),
        F.when(F.col("c_nationkey") == 5, F.array("c_name")).otherwise(F.array("c_name", "c_mktsegment")).alias("databases"),
        F.array("c_name", "c_mktsegment").alias("queries"), some("AUTOMOBILE").alias("nearest_prior_work"),
        F.array("c_name").alias("differentiators"), some("BUILDING").alias("negative_searches"),
        (F.col("c_acctbal") > 1000).alias("all_known_material_data_declared"), (F.col("c_nationkey") > 4).alias("citations_checked_against_sources"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(True)).alias("no_claim_relies_only_on_another_authors_conclusion"),
        (F.col("c_nationkey") != 9).alias("null_and_negative_results_declared"),
        F.lit("").alias("review_status_"), "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")


def _len(extra: int) -> str:
    return f"length(trim(substr(c_name || ' ' || c_mktsegment, 1, c_nationkey + {extra})))"


@query("project_findings", _union(
    _f(1, "QUESTION_UNDERSPECIFIED", "c_custkey", "customer", _len(0) + " < 8"),
    _f(1, "HYPOTHESIS_UNDERSPECIFIED", "c_custkey", "customer", _len(6) + " < 24"),
    _f(1, "FALSIFIER_MISSING", "c_custkey", "customer", _len(2) + " < 16"),
    _f(1, "NEUTRAL_FRAME_MISSING", "c_custkey", "customer", _len(1) + " < 16"),
    _f(1, "OPERATIONAL_DEFINITIONS_MISSING", "c_custkey", "customer", "c_mktsegment = 'BUILDING'"),
    _f(1, "SUCCESS_CRITERIA_MISSING", "c_custkey", "customer", "c_mktsegment = 'MACHINERY'"),
    _f(1, "COMPETING_FRAME_MISSING", "c_custkey", "customer", "c_mktsegment = 'FURNITURE'"),
    _f(1, "SCOPE_BOUNDARIES_MISSING", "c_custkey", "customer", "c_mktsegment = 'HOUSEHOLD'"),
    _f(1, "NOVELTY_SEARCH_INCOMPLETE", "c_custkey", "customer", "c_acctbal < 0 or c_nationkey < 3"),
    _f(1, "NOVELTY_SEARCH_THIN", "c_custkey", "customer", "c_mktsegment = 'AUTOMOBILE' or c_nationkey = 5"),
    _f(1, "NEGATIVE_SEARCH_MISSING", "c_custkey", "customer", "c_mktsegment = 'BUILDING'"),
))
def project_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.project_findings(projects(spark, d), "submission")


@query("project_findings_exploratory", _union(
    _f(1, "QUESTION_UNDERSPECIFIED", "c_custkey", "customer", _len(0) + " < 8"),
    _f(1, "HYPOTHESIS_UNDERSPECIFIED", "c_custkey", "customer", _len(6) + " < 24"),
    _f(1, "FALSIFIER_MISSING", "c_custkey", "customer", _len(2) + " < 16"),
    _f(1, "NEUTRAL_FRAME_MISSING", "c_custkey", "customer", _len(1) + " < 16"),
    _f(1, "OPERATIONAL_DEFINITIONS_MISSING", "c_custkey", "customer", "c_mktsegment = 'BUILDING'", True),
    _f(1, "SUCCESS_CRITERIA_MISSING", "c_custkey", "customer", "c_mktsegment = 'MACHINERY'", True),
    _f(1, "NOVELTY_SEARCH_NOT_STARTED", "c_custkey", "customer", "c_nationkey = 11", True),
))
def project_findings_exploratory(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d).withColumn("novelty_status", F.when(F.col("c_nationkey") == 11, "planned").otherwise(F.col("novelty_status")))
    return rules.project_findings(p, "exploratory")


@query("attestation_findings", _union(
    _f(2, "ATTESTATION_ALL_KNOWN_MATERIAL_DATA_DECLARED", "c_custkey", "customer", "not (c_acctbal > 1000)"),
    _f(2, "ATTESTATION_CITATIONS_CHECKED_AGAINST_SOURCES", "c_custkey", "customer", "c_nationkey <= 4"),
    _f(2, "ATTESTATION_NO_CLAIM_RELIES_ONLY_ON_ANOTHER_AUTHORS_CONCLUSION", "c_custkey", "customer", "c_mktsegment <> 'MACHINERY'"),
    _f(3, "NEGATIVE_RESULTS_ATTESTATION_MISSING", "c_custkey", "customer", "c_nationkey = 9"),
))
def attestation_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.attestation_findings(projects(spark, d), "strict")


# ---- claims and evidence ----------------------------------------------------------------


def claims(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("claim_id"), F.concat("o_orderpriority", F.lit(" causes "), k).alias("statement"),
        F.col("o_orderpriority").alias("population"), F.col("o_orderstatus").alias("setting"), k.alias("timeframe"),
        F.concat("o_orderpriority", k).alias("falsifier"), F.when(F.col("o_orderstatus") == "F", "major").otherwise("minor").alias("importance"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("reconciled with "), "o_orderpriority")).alias("reconciliation"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "randomised assignment").otherwise("none").alias("causal_identification"))


@query("claim_field_findings", _union(
    _f(2, "CLAIM_INCOMPLETE", "o_orderkey", "orders", "length(o_orderpriority || ' causes ' || o_orderkey) < 16"),
    _f(2, "CLAIM_SCOPE_INCOMPLETE", "o_orderkey", "orders", "length(o_orderpriority) < 3 or length(o_orderstatus) < 3 or length(o_orderkey::varchar) < 3"),
    _f(2, "CLAIM_FALSIFIER_MISSING", "o_orderkey", "orders", "length(o_orderpriority || o_orderkey) < 12"),
))
def claim_field_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.claim_field_findings(claims(spark, d), "standard")


def part_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Parts as evidence; lists of a size over 45 are cited but not registered."""
    p = table(spark, d, "part").filter("p_size <= 45")
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") < 20).alias("primary"),
        F.when(F.col("p_type") == "PROMO", " Direct ").otherwise("inferred").alias("directness"),
        F.when(F.col("p_type").isin("SMALL", "LARGE", "MEDIUM"), "Review_Article").otherwise("dataset").alias("source_type"),
        F.when(F.col("p_size") < 10, "observational").otherwise("experimental").alias("kind"))


def line_references(spark: SparkSession, d: str) -> DataFrame:
    """A line item cites its part; returned lines are counter-evidence."""
    role = F.when(F.col("l_returnflag") == "R", "COUNTER").otherwise("SUPPORT")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("evidence_id"), role.alias("role"))


_FACTS = """
ev as (select p_partkey as id, p_size < 20 as prim, p_type = 'PROMO' as direct, p_type in ('SMALL','LARGE','MEDIUM') as sec, p_size < 10 as obs from part where p_size <= 45),
rf as (select l_orderkey as c, l_partkey as e, bool_or(l_returnflag <> 'R') as s, bool_or(l_returnflag = 'R') as k from lineitem group by 1,2),
fx as (select c, count_if(ev.id is not null and s) as known, count_if(ev.id is null) as unk, count_if(ev.id is not null and s and prim and direct) as dp,
 count_if(ev.id is not null and s and sec) as sec, count_if(ev.id is not null and s and obs) as obs, count_if(s and k) as both_, count_if(s) as sup, count_if(k) as cnt
 from rf left join ev on rf.e = ev.id group by c),
q as (select o.*, coalesce(known,0) as known, coalesce(unk,0) as unk, coalesce(dp,0) as dp, coalesce(fx.sec,0) as sec, coalesce(obs,0) as obs, coalesce(both_,0) as both_,
 coalesce(sup,0) as sup, coalesce(cnt,0) as cnt from orders o left join fx on o.o_orderkey = fx.c)"""


@query("claim_evidence_findings", f"with {_FACTS}\n" + _union(
    _f(2, "UNKNOWN_EVIDENCE_REFERENCE", "o_orderkey", "q", "unk > 0"),
    _f(2, "CLAIM_UNSUPPORTED", "o_orderkey", "q", "known = 0"),
    _f(2, "MAJOR_CLAIM_LACKS_DIRECT_PRIMARY_EVIDENCE", "o_orderkey", "q", "o_orderstatus = 'F' and known > 0 and dp = 0"),
    _f(2, "UNRECONCILED_EVIDENCE_ROLE", "o_orderkey", "q", "both_ > 0 and o_orderstatus <> 'O'"),
    _f(2, "SECONDARY_ONLY_SUPPORT", "o_orderkey", "q", "known > 0 and sec = known"),
    _f(2, "CAUSAL_CLAIM_FROM_OBSERVATIONAL_EVIDENCE", "o_orderkey", "q", "obs > 0 and o_orderpriority <> '1-URGENT'"),
    _f(3, "COUNTEREVIDENCE_UNRECONCILED", "o_orderkey", "q", "cnt > 0 and o_orderstatus <> 'O'"),
    _f(3, "TOTAL_EVIDENCE_ROLE_CONFLICT", "o_orderkey", "q", "both_ > 0 and both_ = sup and both_ = cnt"),
))
def claim_evidence_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.claim_evidence_findings(claims(spark, d), line_references(spark, d), part_evidence(spark, d), "strict")


@query("claims_and_evidence_missing", _union(
    _f(2, "CLAIMS_MISSING", "c_custkey", "customer", "c_custkey not in (select o_custkey from orders)"),
    _f(2, "EVIDENCE_MISSING", "o_orderkey", "orders", "o_orderkey not in (select l_orderkey from lineitem)"),
))
def claims_and_evidence_missing(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    a = rules.absent_children(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k")),
                              "k", "CLAIMS_MISSING", 2, "strict")
    b = rules.absent_children(orders.select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")),
                              "k", "EVIDENCE_MISSING", 2, "strict", softened=True)
    return a.unionByName(b)


def evidence_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 7, " ").otherwise(F.col("p_brand")).alias("artifact_path"),
        F.col("p_type").alias("source_locator"), F.col("p_size").cast("string").alias("data_location"), F.col("p_brand").alias("extraction"),
        F.col("p_name").alias("interpretation"), F.concat("p_type", F.lit("  ")).alias("limitations"))


@query("evidence_field_findings", _union(
    _f(2, "EVIDENCE_ARTIFACT_MISSING", "p_partkey", "part", "p_size = 7"),
    _f(2, "SOURCE_LOCATOR_MISSING", "p_partkey", "part", "length(p_type) < 6"), _f(2, "DATA_LOCATION_MISSING", "p_partkey", "part", "length(p_size::varchar) < 4"),
    _f(2, "DIRECT_EXTRACTION_MISSING", "p_partkey", "part", "length(p_brand) < 8"), _f(2, "INTERPRETATION_MISSING", "p_partkey", "part", "length(p_name) < 8"),
    _f(2, "EVIDENCE_LIMITATIONS_MISSING", "p_partkey", "part", "length(p_type) < 8"),
))
def evidence_field_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.evidence_field_findings(evidence_fields(spark, d), "strict")


def evidence_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as evidence files; the labelled ones are in the manifest."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    path = F.concat(F.when(F.col("source") == "src2", "../").otherwise("d/"), F.col("doc_id").cast("string"))
    ev = docs.select(F.col("doc_id").alias("id"), path.alias("artifact_path"),
                     F.when(F.col("source") == "src5", "none").otherwise(F.sha2("text", 256)).alias("sha256"))
    listed = docs.join(labels, "doc_id").select(
        path.alias("relative_path"), F.sha2("text", 256).alias("sha256"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(None)).when(F.col("toxic") == 1, F.sha2("source", 256))
        .otherwise(F.sha2("text", 256)).alias("actual_sha256"))
    return ev, listed


_FILES = "x as (select d.*, l.doc_id is not null as listed, toxic, quality from documents d left join labels l on d.doc_id = l.doc_id)"


@query("evidence_file_findings", f"with {_FILES}\n" + _union(
    _f(2, "EVIDENCE_PATH_INVALID", "doc_id", "x", "source = 'src2' or (listed and toxic = 1 and quality = 0)"),
    _f(2, "EVIDENCE_NOT_MANIFESTED", "doc_id", "x", "source <> 'src2' and not listed"),
    _f(2, "EVIDENCE_HASH_MISMATCH", "doc_id", "x", "source <> 'src2' and listed and toxic = 1 and quality = 1"),
    _f(2, "EVIDENCE_DECLARED_DIGEST_MISMATCH", "doc_id", "x",
       "source <> 'src2' and listed and not (toxic = 1 and quality = 0) and (source = 'src5' or toxic = 1)"),
))
def evidence_file_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.evidence_file_findings(*evidence_files(spark, d), "strict")


@query("duplicate_citations", """
select 'p' || l_partkey as artifact_path, 's' || l_suppkey as source_locator, count(*)::bigint as citations from lineitem where l_returnflag <> 'R'
group by l_partkey, l_suppkey having count(*) > 1""")
def duplicate_citations(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.plans.lineage_queries import lineitem_evidence

    return rules.duplicate_citation_sources(lineitem_evidence(spark, d))


@query("duplicate_citation_findings", """
with e as (select distinct 'p' || l_partkey as a, 's' || l_suppkey as s, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id from lineitem where l_returnflag <> 'R'),
g as (select a, s, list(id order by id) as ids from e group by all having count(*) > 1)
select 2 as gate, 'DUPLICATE_CITATION_SOURCE' as code, 'blocker' as severity, 'FAIL' as status, 'Evidence ' || array_to_string(ids, ', ') as subject, a || ';' || s || ';' || array_to_string(ids, ';') as evidence from g""")
def duplicate_citation_findings(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.plans.lineage_queries import lineitem_evidence

    return rules.duplicate_citation_findings(lineitem_evidence(spark, d), "strict").withColumn("evidence", F.array_join("evidence", ";"))


def receipts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as run receipts of their customer."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("receipt_id"),
        F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "now").otherwise("old").alias("post_records_sha256"),
        F.col("o_orderdate").alias("finished_at"), F.col("o_orderdate").alias("started_at"), (F.col("o_totalprice") > 20000).alias("intact"))


@query("receipt_findings", """
with r as (select *, o_totalprice > 20000 as ok, case when o_orderstatus='F' then 'FAIL' else 'PASS' end as st from orders),
l as (select o_custkey, arg_max(st, (o_orderdate, o_orderkey)) as latest from r where ok group by 1),
g as (select o_custkey, count_if(st='PASS' and o_orderpriority='1-URGENT') as fresh from r where ok group by 1),
p as (select c.*, coalesce(latest,'') as latest, coalesce(fresh,0) as fresh from customer c left join l on l.o_custkey = c.c_custkey left join g on g.o_custkey = c.c_custkey)
""" + _union(
    _f(2, "REPRODUCIBILITY_COMMAND_MISSING", "c_custkey", "p", "c_mktsegment = 'FURNITURE'"),
    _f(2, "FRESH_PASS_RECEIPT_MISSING", "c_custkey", "p", "c_mktsegment not in ('FURNITURE','BUILDING') and (fresh = 0 or latest <> 'PASS')"),
    _f(2, "RECEIPT_DAMAGED", "o_orderkey", "r", "not ok"),
))
def receipt_findings(spark: SparkSession, d: str) -> DataFrame:
    command = F.when(F.col("c_mktsegment") == "FURNITURE", "").when(
        F.col("c_mktsegment") == "BUILDING", "N/A: theoretical study").otherwise("make all")
    p = table(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"), F.lit("now").alias("records_sha256"), command.alias("reproducibility_command"))
    return rules.receipt_findings(p, receipts(spark, d), "strict")


# ---- methods ----------------------------------------------------------------------------


@query("method_findings", "with m as (select *, case when c_mktsegment = 'BUILDING' then 'not_applicable: no sampling was done' when c_mktsegment = 'MACHINERY' then 'n/a: none' else substr(c_name,1,c_nationkey) end as v from customer)\n" + _union(
    *[_f(3, code, "c_custkey", "m", f"length(trim(v)) < {n} and c_mktsegment <> 'BUILDING'") for n, code in R.METHOD_FIELDS.values()],
    _f(3, "SAMPLE_SIZE_MISSING", "c_custkey", "m", "c_mktsegment <> 'FURNITURE' and c_acctbal <= 0"),
    _f(3, "CONTROLS_MISSING", "c_custkey", "m", "c_mktsegment = 'HOUSEHOLD'"), _f(3, "EXCLUSIONS_UNDECLARED", "c_custkey", "m", "c_nationkey = 1"),
))
def method_findings(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("c_mktsegment") == "BUILDING", "not_applicable: no sampling was done").when(
        F.col("c_mktsegment") == "MACHINERY", "n/a: none").otherwise(F.substring("c_name", F.lit(1), F.col("c_nationkey")))
    empty = F.array().cast("array<string>")
    methods = table(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"), *[value.alias(n) for n in R.METHOD_FIELDS],
        F.when(F.col("c_mktsegment") == "FURNITURE", "tool").otherwise("research").alias("kind"),
        F.ceil("c_acctbal").cast("long").alias("sample_size"),  # a part of one still is above none
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", empty).otherwise(F.array("c_name")).alias("controls"),
        F.when(F.col("c_nationkey") == 1, F.array(F.lit(" "))).otherwise(F.array("c_name")).alias("exclusions"))
    methods = methods.withColumn("sample_size", F.when(F.col("sample_size") < 1, F.col("sample_size")).otherwise(F.lit(1)))
    return rules.method_findings(methods, "strict")


def supplier_children(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("project_id"), "s_name", "s_acctbal")


@query("collection_findings", _union(
    _f(3, "ASSUMPTIONS_UNDECLARED", "n_nationkey", "nation", "n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)"),
    _f(3, "ALTERNATIVE_EXPLANATIONS_MISSING", "n_nationkey", "nation", "n_nationkey not in (select s_nationkey from supplier where s_acctbal > 6000)"),
    _f(3, "ADVERSARIAL_TESTS_MISSING", "n_nationkey", "nation", "n_nationkey not in (select s_nationkey from supplier where s_acctbal > 7000)"),
    _f(3, "REVIEWER_OBJECTIONS_MISSING", "n_nationkey", "nation", "n_nationkey not in (select s_nationkey from supplier where s_acctbal > 8000)"),
    _f(3, "LIMITATIONS_MISSING", "n_nationkey", "nation", "n_nationkey not in (select s_nationkey from supplier where s_acctbal > 9000)"),
))
def collection_findings(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"))
    children = supplier_children(spark, d)
    parts = {n: children.filter(F.col("s_acctbal") > 5000 + 1000 * i) for i, n in enumerate(rules.COLLECTION_RULES)}
    return rules.collection_findings(parents, parts, "strict")


@query("assumption_findings", _union(
    _f(3, "ASSUMPTION_INCOMPLETE", "p_partkey", "part", "length(p_name) < 8 or length(p_type) < 8 or length(p_brand) < 8"),
    _f(3, "ADVERSARIAL_TEST_INCOMPLETE", "p_partkey", "part", "length(p_size::varchar) < 3"),
    _f(3, "ADVERSARIAL_TEST_NOT_RESOLVED", "p_partkey", "part", "p_type <> 'PROMO'"),
    _f(3, "CONTRADICTION_UNRESOLVED", "p_partkey", "part", "p_type not in ('LARGE','SMALL') or length(p_name) < 12"),
    _f(3, "MANDATORY_GATE_WAIVER_REFUSED", "p_partkey", "part", "p_type in ('STANDARD','ECONOMY')"),
))
def assumption_findings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    a = rules.assumption_findings(p.select("id", F.col("p_name").alias("statement"), F.col("p_type").alias("risk"), F.col("p_brand").alias("test")), "submission")
    status = F.when(F.col("p_type") == "PROMO", " Passed ").otherwise("open")
    b = rules.adversarial_findings(p.select("id", F.col("p_name").alias("target"), F.col("p_type").alias("procedure"), F.col("p_brand").alias("failure_condition"),
                                            F.col("p_size").cast("string").alias("result"), status.alias("status")), "submission")
    c = rules.contradiction_findings(p.select("id", F.when(F.col("p_type") == "LARGE", "Resolved").when(F.col("p_type") == "SMALL", "explained").otherwise("open").alias("status"),
                                              F.col("p_name").alias("resolution")), "submission")
    w = rules.waiver_findings(p.select("id", F.when(F.col("p_type") == "STANDARD", "Blocker").when(F.col("p_type") == "ECONOMY", "critical").otherwise("minor").alias("severity")), "submission")
    return a.unionByName(b).unionByName(c).unionByName(w)


@query("ethics_and_submission_findings", _union(
    _f(3, "ETHICS_STATUS_MISSING", "c_custkey", "customer", "c_mktsegment = 'BUILDING'"),
    _f(3, "ETHICS_RISK_UNMITIGATED", "c_custkey", "customer", "c_nationkey < 6"),
    _f(3, "SUBMISSION_METADATA_INCOMPLETE", "c_custkey", "customer", "c_nationkey < 12 or c_mktsegment = 'FURNITURE'"),
))
def ethics_and_submission_findings(spark: SparkSession, d: str) -> DataFrame:
    c, empty = table(spark, d, "customer"), F.array().cast("array<string>")
    a = c.select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_mktsegment") != "BUILDING", "exempt").alias("review_status"),
                 F.array("c_name", "c_mktsegment").alias("risks"), F.when(F.col("c_nationkey") < 6, F.array("c_name")).otherwise(F.array("c_name", "c_mktsegment")).alias("mitigations"))
    b = c.select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("field"),
                 F.when(F.col("c_mktsegment") == "FURNITURE", empty).otherwise(F.array("c_name")).alias("target_venues"), F.array("c_name").alias("author_names"),
                 F.col("c_name").alias("corresponding_author"), F.substring("c_name", F.lit(1), F.col("c_nationkey")).alias("data_availability"), F.col("c_name").alias("code_availability"))
    return rules.ethics_findings(a, "submission").unionByName(rules.submission_findings(b, "submission"))


@query("submission_gaps", """
select 3 as gate, 'SUBMISSION_METADATA_INCOMPLETE' as code, 'blocker' as severity, 'FAIL' as status, c_custkey::varchar as subject,
 concat_ws(';', case when c_mktsegment = 'FURNITURE' then 'target_venues' end, case when c_nationkey < 12 then 'data_availability' end) as evidence
from customer where c_nationkey < 12 or c_mktsegment = 'FURNITURE'""")
def submission_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The submission finding of a project with the fields that it lacks."""
    c = table(spark, d, "customer")
    venues = F.when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit(" "))).otherwise(F.array("c_name"))
    rows = c.select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("field"), venues.alias("target_venues"), F.array("c_name").alias("author_names"),
                    F.col("c_name").alias("corresponding_author"), F.substring("c_name", F.lit(1), F.col("c_nationkey")).alias("data_availability"), F.col("c_name").alias("code_availability"))
    return rules.submission_gaps(rows, "submission").withColumn("evidence", F.array_join("evidence", ";"))


# ---- gates ------------------------------------------------------------------------------


@query("gate_status", f"with {_FACTS}, f as (" + _union(
    _f(2, "CLAIM_UNSUPPORTED", "o_orderkey", "q", "known = 0"), _f(2, "UNKNOWN_EVIDENCE_REFERENCE", "o_orderkey", "q", "unk > 0"),
    _f(2, "MAJOR_CLAIM_LACKS_DIRECT_PRIMARY_EVIDENCE", "o_orderkey", "q", "o_orderstatus = 'F' and known > 0 and dp = 0"),
    _f(2, "UNRECONCILED_EVIDENCE_ROLE", "o_orderkey", "q", "both_ > 0 and o_orderstatus <> 'O'"),
    _f(2, "SECONDARY_ONLY_SUPPORT", "o_orderkey", "q", "known > 0 and sec = known"),
    _f(2, "CAUSAL_CLAIM_FROM_OBSERVATIONAL_EVIDENCE", "o_orderkey", "q", "obs > 0 and o_orderpriority <> '1-URGENT'"),
    _f(3, "COUNTEREVIDENCE_UNRECONCILED", "o_orderkey", "q", "cnt > 0 and o_orderstatus <> 'O'"),
    _f(3, "TOTAL_EVIDENCE_ROLE_CONFLICT", "o_orderkey", "q", "both_ > 0 and both_ = sup and both_ = cnt")) + """)
select gate, count(*)::bigint as findings, count(*)::bigint as failed_blockers, 'FAIL' as gate_status from f group by gate""")
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_status(claim_evidence_findings(spark, d))


@query("audit_status", _union(
    "with f as (" + _f(1, "QUESTION_UNDERSPECIFIED", "c_custkey", "customer", _len(0) + " < 8"),
    _f(1, "HYPOTHESIS_UNDERSPECIFIED", "c_custkey", "customer", _len(6) + " < 24"), _f(1, "FALSIFIER_MISSING", "c_custkey", "customer", _len(2) + " < 16"),
    _f(1, "NEUTRAL_FRAME_MISSING", "c_custkey", "customer", _len(1) + " < 16"),
    _f(1, "OPERATIONAL_DEFINITIONS_MISSING", "c_custkey", "customer", "c_mktsegment = 'BUILDING'", True),
    _f(1, "SUCCESS_CRITERIA_MISSING", "c_custkey", "customer", "c_mktsegment = 'MACHINERY'", True),
    _f(1, "NOVELTY_SEARCH_NOT_STARTED", "c_custkey", "customer", "c_nationkey = 11", True)) + """)
select count_if(status='FAIL')::bigint as failed_blockers, count_if(status='WARN')::bigint as warnings, 'FAIL' as audit_status from f""")
def audit_status(spark: SparkSession, d: str) -> DataFrame:
    return gates.audit_status(project_findings_exploratory(spark, d))


_CODES = ["CLAIM_INCOMPLETE", "CLAIM_FALSIFIER_MISSING", "EVIDENCE_HASH_MISMATCH", "LOADED_FRAMING", "NOT_A_KNOWN_CODE"]
_PRIORITY = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


def order_findings(spark: SparkSession, d: str) -> DataFrame:
    """One finding per order; its code follows the priority."""
    table_ = F.create_map(*[F.lit(x) for p in zip(_PRIORITY, _CODES) for x in p])
    return table(spark, d, "orders").select(
        F.lit(2).alias("gate"), table_[F.col("o_orderpriority")].alias("code"), F.col("o_orderkey").cast("string").alias("subject"),
        F.concat(F.lit("order "), "o_orderstatus").alias("message"), F.when(F.col("o_orderstatus") == "P", "warning").otherwise("blocker").alias("severity"))


_CODE = "case o_orderpriority " + " ".join(f"when '{p}' then '{c}'" for p, c in zip(_PRIORITY, _CODES)) + " end"


@query("failure_classes", f"""
with f as (select {_CODE} as code from orders)
select code, case code when 'CLAIM_INCOMPLETE' then 'FAIL_INCOMPLETE' when 'CLAIM_FALSIFIER_MISSING' then 'FAIL_UNTESTABLE' when 'EVIDENCE_HASH_MISMATCH' then 'FAIL_TAMPERED'
 when 'LOADED_FRAMING' then 'FRAMING_PREDETERMINES_RESULT' else 'FAIL_UNSUPPORTED' end as failure_status,
 case code when 'EVIDENCE_HASH_MISMATCH' then 'FATAL' else 'BLOCKING' end as failure_severity,
 case code when 'CLAIM_INCOMPLETE' then 'incomplete' when 'CLAIM_FALSIFIER_MISSING' then 'untestable' when 'EVIDENCE_HASH_MISMATCH' then 'tampered'
 when 'LOADED_FRAMING' then 'framing' else 'unsupported' end as failure_group, count(*)::bigint as findings from f group by code""")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    out = gates.classified(order_findings(spark, d))
    return out.groupBy("code", "failure_status", "failure_severity", "failure_group").agg(F.count(F.lit(1)).alias("findings"))


@query("owned_findings", f"""
with f as (select {_CODE} as code, o_orderstatus from orders)
select case code when 'CLAIM_INCOMPLETE' then 'claim_map_complete' when 'CLAIM_FALSIFIER_MISSING' then 'claim_map_complete' when 'EVIDENCE_HASH_MISMATCH' then 'artifact_hashes_match'
 else 'no_assumed_conclusion' end as check_id, count(*)::bigint as findings from f where code <> 'NOT_A_KNOWN_CODE' and (code <> 'LOADED_FRAMING' or o_orderstatus = 'F') group by 1""")
def owned_findings(spark: SparkSession, d: str) -> DataFrame:
    """Framing is a matter of gate 1: the same code found at gate 2 belongs to no check."""
    framed = (F.col("code") == "LOADED_FRAMING") & (F.col("message") == "order F")
    findings = order_findings(spark, d).withColumn("gate", F.when(framed, 1).otherwise(F.col("gate")))
    return gates.owned_findings(findings).groupBy("check_id").agg(F.count(F.lit(1)).alias("findings"))


def supplier_checks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as checks of their nation's gate; the balance gives the status."""
    b = F.col("s_acctbal")
    status = F.when(b < 0, "BLOCKED_MISSING_ACCESS").when(b < 1000, "FAIL_STALE").when(b < 2000, "FAIL_INCOMPLETE").when(
        b < 3000, "NEEDS_CLARIFICATION").when(b < 3500, "NOT_APPLICABLE").otherwise("PASS")
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("gate"), F.col("s_name").alias("check_id"), status.alias("status"))


_CHECKS = """k as (select s_nationkey as gate, s_name as check_id, case when s_acctbal < 0 then 'BLOCKED_MISSING_ACCESS' when s_acctbal < 1000 then 'FAIL_STALE'
 when s_acctbal < 2000 then 'FAIL_INCOMPLETE' when s_acctbal < 3000 then 'NEEDS_CLARIFICATION' when s_acctbal < 3500 then 'NOT_APPLICABLE' else 'PASS' end as status from supplier)"""


@query("gate_counts", f"""with {_CHECKS}
select gate, (count(*) + case when gate < 5 then 1 else 0 end)::bigint as required_check_count, count(*)::bigint as executed_check_count, count_if(status='PASS')::bigint as passed_check_count, count_if(status like 'FAIL%')::bigint as failed_check_count,
 count_if(status like 'BLOCKED%')::bigint as blocked_check_count, count_if(status='NOT_APPLICABLE')::bigint as not_applicable_count,
 count_if(status like 'FAIL%' or status like 'BLOCKED%')::bigint as unresolved_blocker_count,
 case when count_if(status like 'BLOCKED%') > 0 then 'BLOCKED_MISSING_ACCESS' when count_if(status='FAIL_INCOMPLETE') > 0 then 'FAIL_INCOMPLETE' when count_if(status='FAIL_STALE') > 0 then 'FAIL_STALE'
  when count_if(status='NEEDS_CLARIFICATION') > 0 then 'NEEDS_CLARIFICATION' else 'PASS' end as decision from k group by gate""")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Gates below 5 require one check more than they have run."""
    checks = supplier_checks(spark, d)
    more = checks.filter("gate < 5").select("gate", F.lit("not run").alias("check_id")).distinct()
    return gates.gate_counts(checks, required=checks.select("gate", "check_id").unionByName(more))


@query("check_membership", f"""with {_CHECKS}, have as (select gate, check_id from k where status <> 'FAIL_STALE' union all select gate, 'extra' from k where status = 'FAIL_STALE'
 union all select gate, check_id from k where status = 'NOT_APPLICABLE'), h as (select gate, check_id, count(*) as n from have group by 1,2)
select coalesce(h.gate, k.gate) as gate, coalesce(h.check_id, k.check_id) as check_id, case when h.gate is null then 'CHECK_MISSING' when k.gate is null then 'CHECK_UNEXPECTED' else 'CHECK_REPEATED' end as problem
from h full outer join k on h.gate = k.gate and h.check_id = k.check_id where h.gate is null or k.gate is null or h.n > 1""")
def check_membership(spark: SparkSession, d: str) -> DataFrame:
    want = supplier_checks(spark, d)
    have = want.filter("status <> 'FAIL_STALE'").unionByName(want.filter("status = 'FAIL_STALE'").withColumn("check_id", F.lit("extra"))).unionByName(
        want.filter("status = 'NOT_APPLICABLE'"))
    return gates.check_membership(have, want)


@query("gate_zero", """
with s as (select c_custkey, case when c_mktsegment='BUILDING' then 'NONE' when c_mktsegment='FURNITURE' then 'AMBIGUOUS' when c_acctbal < 0 then 'TAMPERED' when c_nationkey < 5 then 'STALE' when c_nationkey < 15 then 'PASS' else 'FAIL' end as st from customer)
select c_custkey as project_id, 0 as gate, case st when 'PASS' then 'PASS' when 'FAIL' then 'FAIL_DATA_NOT_READY' when 'STALE' then 'FAIL_STALE' when 'TAMPERED' then 'FAIL_TAMPERED' when 'AMBIGUOUS' then 'BLOCKED_AMBIGUOUS_IDENTITY' else 'BLOCKED_MISSING_ARTIFACT' end as decision from s
union all select c_custkey, 1, case when st = 'PASS' then 'PASS' else 'BLOCKED_BY_GATE_0' end from s""")
def gate_zero(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("c_mktsegment") == "BUILDING", "NONE").when(F.col("c_mktsegment") == "FURNITURE", "AMBIGUOUS").when(
        F.col("c_acctbal") < 0, "TAMPERED").when(F.col("c_nationkey") < 5, "STALE").when(F.col("c_nationkey") < 15, "PASS").otherwise("FAIL")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), state.alias("st"))
    zero = c.select("project_id", F.lit(0).alias("gate"), gates.gate_zero(F.col("st")).alias("decision"))
    one = c.select("project_id", F.lit(1).alias("gate"), F.lit("PASS").alias("decision"))
    return gates.gated(zero.unionByName(one))


def order_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as gate decisions of their customer: the gate follows the priority."""
    gate = F.create_map(*[F.lit(x) for p in zip(_PRIORITY[:4], (0, 1, 2, 3)) for x in p])
    return table(spark, d, "orders").filter("o_orderpriority <> '1-URGENT'").select(
        F.col("o_custkey").alias("project_id"), gate[F.col("o_orderpriority")].alias("gate"),
        F.when(F.col("o_orderstatus") == "F", "FAIL_STALE").otherwise("PASS").alias("decision"), F.col("o_orderdate").alias("decided_at"),
        F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "P", "old").otherwise("live").alias("binding_digest"),
        (F.col("o_totalprice") > 400000).cast("int").alias("unresolved_blocker_count"))


_LATEST = """d as (select o_custkey as project_id, case o_orderpriority when '5-LOW' then 0 when '4-NOT SPECIFIED' then 1 when '3-MEDIUM' then 2 else 3 end as gate, *,
 row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderpriority <> '1-URGENT'),
n as (select project_id, gate, case when o_orderstatus='F' then 'FAIL_STALE' else 'PASS' end as decision, o_orderkey as record_id, case when o_orderstatus='P' then 'old' else 'live' end as binding_digest,
 (o_totalprice > 400000)::int as unresolved_blocker_count from d where rn = 1)"""


@query("latest_decisions", f"with {_LATEST} select * from n")
def latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    return gates.latest_decisions(order_decisions(spark, d)).drop("decided_at")


@query("eligibility_blockers", f"""with {_LATEST}, g as (select c_custkey as project_id, c_nationkey, unnest([0,1,2,3]) as gate from customer),
j as (select g.project_id, g.gate, decision, binding_digest, unresolved_blocker_count from g left join n on n.project_id = g.project_id and n.gate = g.gate)
select project_id, gate, 'GATE_NOT_DECIDED' as blocker from j where decision is null union all select project_id, gate, 'GATE_NOT_PASS' from j where decision <> 'PASS'
union all select project_id, gate, 'GATE_OTHER_BINDING' from j where decision = 'PASS' and binding_digest <> 'live' union all select project_id, gate, 'UNRESOLVED_BLOCKERS' from j where unresolved_blocker_count > 0
union all select c_custkey, null, 'VERIFIER_NOT_PASS' from customer where c_nationkey = 2 or c_acctbal < 0 union all select c_custkey, null, 'VERIFIER_OTHER_BINDING' from customer where c_nationkey = 4 and c_acctbal >= 0""")
def eligibility_blockers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("project_id"), F.lit("live").alias("binding_digest"))
    v = c.filter("c_nationkey <> 2").select(
        F.col("c_custkey").alias("project_id"), F.when(F.col("c_acctbal") < 0, "FAIL").otherwise("PASS").alias("verifier_decision"),
        F.when(F.col("c_nationkey") == 4, "old").otherwise("live").alias("verified_digest"))
    return gates.eligibility_blockers(p, gates.latest_decisions(order_decisions(spark, d)), v)


_BIND = """i as (select distinct l_orderkey as k, sha256(l_returnflag || '=' || l_partkey) as h from lineitem),
b5 as (select k, substr(h,1,5) as p, sha256(string_agg(h, ',' order by h)) as d from i group by 1,2),
b2 as (select k, substr(p,1,2) as q, sha256(string_agg(p || '=' || d, ',' order by p || '=' || d)) as d from b5 group by 1,2),
b0 as (select k, sha256(string_agg(q || '=' || d, ',' order by q || '=' || d)) as d from b2 group by 1)"""


def order_bindings(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_returnflag").alias("section"), F.col("l_partkey").cast("string").alias("item"))
    return gates.binding_digests(parts)


@query("binding_digests", f"with {_BIND} select k as project_id, d as binding_digest from b0")
def binding_digests(spark: SparkSession, d: str) -> DataFrame:
    return order_bindings(spark, d)


@query("verification_errors", f"""with {_BIND}
select o_orderkey as project_id, 'DECLARED_DIGEST' as error, null::int as gate from orders join b0 on k = o_orderkey where o_orderpriority = '1-URGENT'
union all select o_orderkey, 'GATE_DIGEST', 2 from orders join b0 on k = o_orderkey where o_orderstatus = 'P'""")
def verification_errors(spark: SparkSession, d: str) -> DataFrame:
    live = order_bindings(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), "o_orderpriority", "o_orderstatus").join(live, "project_id")
    declared = o.select("project_id", F.when(F.col("o_orderpriority") == "1-URGENT", "x").otherwise(F.col("binding_digest")).alias("binding_digest"))
    decided = o.select("project_id", F.lit(2).alias("gate"), F.when(F.col("o_orderstatus") == "P", "x").otherwise(F.col("binding_digest")).alias("binding_digest"))
    return gates.verification_errors(declared, live, decided)


@query("nonblocking_limitations", """
select s_nationkey as project_id, count(*)::bigint as limitations, bool_and(s_acctbal > 1000 and s_suppkey >= 5) as conditions_met from supplier group by 1""")
def nonblocking_limitations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("project_id"), (F.col("s_acctbal") > 1000).alias("scope_excludes_affected"), F.lit(True).alias("recorded_in_payload"),
        (F.col("s_suppkey") >= 5).alias("deterministic_rule"), F.lit(True).alias("independent_verifier_confirms"))
    return gates.nonblocking(rows)


_GAP = """'{"affected_artifacts":[],"affected_claims":["' || o_orderkey || '"],"failure_code":"' || code || '","gate":2,"observed_fact":"order ' || o_orderstatus || '","why_it_matters":""}' || chr(10)"""


@query("gap_rows", f"""
with f as (select *, {_CODE} as code from orders)
select substr(sha256({_GAP}),1,16) as gap_id, 2 as gate, code as failure_code, case code when 'EVIDENCE_HASH_MISMATCH' then 'FATAL' else 'BLOCKING' end as severity,
 'order ' || o_orderstatus as observed_fact, o_orderkey::varchar as affected_claims, 'open' as status, 'REQUIRES_SOURCE_ARTIFACT' as action from f""")
def gap_rows(spark: SparkSession, d: str) -> DataFrame:
    return gates.gap_rows(order_findings(spark, d)).select(
        "gap_id", "gate", "failure_code", "severity", "observed_fact", F.array_join("affected_claims", ";").alias("affected_claims"), "status", "action")


_PRINT = """sha256('{"code":"' || code || '","gate":2,"message":"order ' || o_orderstatus || '","subject":"' || o_orderkey || '"}' || chr(10))"""


def open_items(spark: SparkSession, d: str) -> DataFrame:
    """Open items of an earlier audit: urgent and high findings, some already resolved."""
    old = order_findings(spark, d).filter("code in ('NOT_A_KNOWN_CODE','LOADED_FRAMING')")
    return old.select(
        gates.fingerprint().alias("fingerprint_sha256"), F.when(F.col("message") == "order O", "resolved").otherwise("open").alias("status"),
        F.lit("t0").alias("created_at"), F.lit("t0").alias("last_seen_at"), F.when(F.col("message") == "order O", "t1").alias("resolved_at"), F.lit("n").alias("note"))


_SYNC = f"""f as (select *, {_CODE} as code from orders), a as (select *, {_PRINT} as p from f),
s as (select p, case when o_orderstatus = 'O' then 'resolved' else 'open' end as st, case when o_orderstatus='O' then 't1' end as rs from a where code in ('NOT_A_KNOWN_CODE','LOADED_FRAMING')),
b as (select distinct p from a where o_orderstatus <> 'P' and code <> 'LOADED_FRAMING'),
y as (select coalesce(s.p, b.p) as fingerprint_sha256, case when b.p is not null then 'open' when st = 'open' then 'resolved' else st end as status, case when s.p is null then 't2' else 't0' end as created_at,
 case when b.p is not null then 't2' else 't0' end as last_seen_at, case when b.p is not null then null when st='open' then 't2' else rs end as resolved_at,
 case when b.p is not null then '' when st='open' then 'resolved by the latest audit' else 'n' end as note from s full outer join b on s.p = b.p)"""


def synced_items(spark: SparkSession, d: str) -> DataFrame:
    now = order_findings(spark, d).filter("code <> 'LOADED_FRAMING'")
    return gates.sync_open_items(open_items(spark, d), now, "t2")


@query("open_item_sync", f"with {_SYNC} select * from y")
def open_item_sync(spark: SparkSession, d: str) -> DataFrame:
    return synced_items(spark, d)


@query("open_item_updates", f"with {_SYNC} select * replace (case when substr(fingerprint_sha256,1,1) = 'a' then 'resolved' else status end as status, case when substr(fingerprint_sha256,1,1) = 'a' then 'by hand' else note end as note) from y")
def open_item_updates(spark: SparkSession, d: str) -> DataFrame:
    state = synced_items(spark, d)
    updates = state.filter("substr(fingerprint_sha256,1,1) = 'a'").select("fingerprint_sha256", F.lit("resolved").alias("status"), F.lit("by hand").alias("note"))
    return gates.apply_status_updates(state, updates)


@query("decision_cards", f"""
with g as (select s_nationkey as project_id, count(*) as key_findings, count_if(s_acctbal < 0) as blockers from supplier group by 1)
select project_id, key_findings::bigint as key_findings, blockers::bigint as blockers, {sql_hash({'project_id': 'n', 'key_findings': 'n', 'blockers': 'n'})} as card_sha256 from g""")
def decision_cards(spark: SparkSession, d: str) -> DataFrame:
    return gates.decision_cards(table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("project_id")).agg(
        F.count(F.lit(1)).alias("key_findings"), F.count_if(F.col("s_acctbal") < 0).alias("blockers")))


# ---- contracts (N) ----------------------------------------------------------------------


@query("record_contract", """
select c_custkey::varchar as subject, '/c_name' as pointer, 'PATTERN' as problem from customer where not regexp_matches(c_name, '^Customer#[0-9]{8}[0-4]$')
union all select c_custkey::varchar, '/c_mktsegment', 'ENUM' from customer where c_mktsegment not in ('BUILDING','MACHINERY','HOUSEHOLD')
union all select c_custkey::varchar, '/c_acctbal', 'MINIMUM' from customer where c_acctbal < 0 union all select c_custkey::varchar, '/c_acctbal', 'MAXIMUM' from customer where c_acctbal > 9000
union all select c_custkey::varchar, '/c_nationkey', 'REQUIRED' from customer where c_nationkey = 7 union all select c_custkey::varchar, '/c_mktsegment', 'MAX_LENGTH' from customer where length(c_mktsegment) > 9
union all select c_custkey::varchar, '/tags', 'UNIQUE_ITEMS' from customer where c_mktsegment = 'BUILDING' union all select c_custkey::varchar, '/', 'RICH_NEEDS_NATION' from customer where c_acctbal > 5000 and c_nationkey <= 3""")
def record_contract(spark: SparkSession, d: str) -> DataFrame:
    R_ = contracts.FieldRule
    rows = table(spark, d, "customer").withColumns({
        "c_nationkey": F.when(F.col("c_nationkey") != 7, F.col("c_nationkey")), "nk": F.col("c_nationkey"),
        "tags": F.when(F.col("c_mktsegment") == "BUILDING", F.array("c_name", "c_name")).otherwise(F.array("c_name"))})
    rule_set = [
        R_("c_name", "pattern", "^Customer#[0-9]{8}[0-4]$"), R_("c_mktsegment", "enum", ("BUILDING", "MACHINERY", "HOUSEHOLD")),
        R_("c_acctbal", "minimum", 0), R_("c_acctbal", "maximum", 9000), R_("c_nationkey", "required"), R_("c_mktsegment", "max_length", 9),
        R_("tags", "unique_items"), R_("tags", "min_items", 1)]
    return contracts.violations(rows, "c_custkey", rule_set, {"RICH_NEEDS_NATION": ~((F.col("c_acctbal") > 5000) & (F.col("nk") <= 3))})


@query("path_safety", """
select doc_id, not (lang = 'de' or lang = 'fr' and source = 'src1' or source = 'src2') as safe from documents""")
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.integrity import safe_relative_path

    k = F.col("doc_id").cast("string")
    path = F.when(F.col("lang") == "de", F.concat(F.lit("/abs/"), k)).when((F.col("lang") == "fr") & (F.col("source") == "src1"), F.concat(F.lit("a/../"), k)).when(
        F.col("source") == "src2", F.concat(F.lit("C:x/"), k)).otherwise(F.concat(F.lit("a/b.c/"), k))
    return table(spark, d, "documents").select("doc_id", safe_relative_path(path).alias("safe"))


@query("structure_violations", """
select l_orderkey::varchar as subject, '/claims/id' as pointer, 'DUPLICATE_ID' as problem from lineitem group by l_orderkey having count(*) > 1
union all select distinct l_orderkey::varchar, '/claims/evidence_id', 'UNKNOWN_REFERENCE' from lineitem where l_suppkey > 24""")
def structure_violations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("evidence_id"))
    ev = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return contracts.structure_violations({"claims": li, "evidence": ev}, [("claims", "evidence_id", "evidence", "id")]).repartition(tasks_for(li), "subject").distinct()


@query("run_structure", """
with p as (select l_orderkey as k, count_if(l_returnflag='N') as op, count_if(l_returnflag='R') as df from lineitem group by 1),
r as (select o_orderkey as k, case o_orderstatus when 'F' then 'COMPLETE' when 'O' then 'COMPLETE_WITH_DEFERRED_SOFT_GATES' else 'IMPLEMENTING' end as st, o_orderpriority='1-URGENT' as bad, coalesce(op,0) as op, coalesce(df,0) as df, p.k is not null as has from orders left join p on p.k = o_orderkey)
select k::varchar as subject, '/' as pointer, 'OUTCOME_MATCHES_STATE' as problem from r where bad union all select k::varchar, '/', 'COMPLETE_HAS_NO_OPEN_PACKAGE' from r where st like 'COMPLETE%' and op > 0
union all select k::varchar, '/', 'DEFERRAL_NEEDS_DEFERRED_STATE' from r where st = 'COMPLETE' and df > 0 union all select k::varchar, '/', 'HAS_PACKAGE' from r where not has""")
def run_structure(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.integrity import state_outcome

    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "COMPLETE_WITH_DEFERRED_SOFT_GATES").otherwise("IMPLEMENTING")
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), state.alias("state"), F.when(
        F.col("o_orderpriority") == "1-URGENT", "none").otherwise(state_outcome(state)).alias("outcome"))
    status = F.when(F.col("l_returnflag") == "N", "OPEN").when(F.col("l_returnflag") == "R", "DEFERRED").otherwise("DONE")
    packages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), status.alias("status"))
    return contracts.run_structure_violations(runs, packages)


@query("plan_labels", "select c_mktsegment as label, count(*)::bigint as plans from customer group by 1")
def plan_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return contracts.plan_summary(c, ["label"], "label")[1]


@query("unfinished_plans", """
select doc_id as id, case when lang = 'de' then 'design;population' when lang = 'fr' then 'design' else 'population' end as missing_fields from documents where lang in ('de','fr','es')""")
def unfinished_plans(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("lang").isin("de", "fr"), " ").otherwise(F.col("text")).alias("design"),
        F.when(~F.col("lang").isin("de", "es"), F.col("source")).alias("population"), "lang")
    missing, _ = contracts.plan_summary(plans, ["design", "population"], "lang")
    return missing.select("id", F.array_join("missing_fields", ";").alias("missing_fields"))


@query("entry_contract", """
select 'e' || doc_id as subject, '/' as pointer, 'TEXT_HASH' as problem from documents where source = 'src1' union all select 'e' || doc_id, '/', 'SUMMARY_DIFFERS' from documents where source = 'src2'
union all select 'e' || doc_id, '/', 'ENTRY_HASH' from documents where source in ('src1','src3') union all select 'e' || doc_id, '/revision', 'MINIMUM' from documents where source = 'src4'""")
def entry_contract(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.functions.canon import record_hash

    e = table(spark, d, "documents").select(
        F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("entry_id"), F.col("text").alias("exact_text"), F.sha2("text", 256).alias("exact_text_sha256"),
        F.when(F.col("source") == "src2", F.col("text")).otherwise(F.col("source")).alias("summary"), F.when(F.col("source") == "src4", 0).otherwise(1).alias("revision"), "source")
    e = e.withColumn("summary_sha256", F.sha2("summary", 256))
    body = [c for c in e.columns if c != "source"]
    e = e.withColumn("entry_hash", record_hash(e, body))
    e = e.withColumn("exact_text_sha256", F.when(F.col("source") == "src1", F.sha2("source", 256)).otherwise(F.col("exact_text_sha256")))
    e = e.withColumn("entry_hash", F.when(F.col("source") == "src3", F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash")))
    return contracts.entry_violations(e.drop("source"))


@query("link_contract", """
with k as (select l_orderkey as e, l_partkey as t, l_returnflag as r, l_linenumber from lineitem)
select e || '/' || t || '/' || l_linenumber as subject, '/relation' as pointer, 'ENUM' as problem from k where r = 'R' union all select e || '/' || t || '/' || l_linenumber, '/', 'NOT_SELF' from k where e = t
union all select e || '/' || t || '/' || r, '/', 'DUPLICATE_LINK' from k group by e, t, r having count(*) > 1
union all select distinct e || '/' || t || '/' || l_linenumber, '/entry_id', 'UNKNOWN_REFERENCE' from k where e not in (select c_custkey from customer)""")
def link_contract(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber")]).alias("link_id"),
        F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("relation"))
    return contracts.link_violations(li, table(spark, d, "customer").select(F.col("c_custkey").alias("entry_id")), ["A", "N"])


@query("checkpoint_contract", """
with e as (select event_id, case when event_type = 'error' then 'x' else sha256(event_id::varchar) end as h, event_type, value from events)
select 'gen-' || substr(sha256('{"parent_generation_id":null,"records_sha256":"' || h || '"}' || chr(10)),1,16) as subject, '/records_sha256' as pointer, 'SHA256' as problem from e where event_type='error'
union all select 'gen-' || substr(sha256('{"parent_generation_id":null,"records_sha256":"' || h || '"}' || chr(10)),1,16), '/record_count', 'MINIMUM' from e where value < 1
union all select repeat('0',20), '/', 'ID_RECOMPUTES' from e where event_type='click' and value >= 1 and value < 2 union all select repeat('0',20), '/checkpoint_id', 'PATTERN' from e where event_type='click' and value >= 1 and value < 2""")
def checkpoint_contract(spark: SparkSession, d: str) -> DataFrame:
    digest = F.when(F.col("event_type") == "error", "x").otherwise(F.sha2(F.col("event_id").cast("string"), 256))
    none = F.lit(None).cast("string")
    spoiled = (F.col("event_type") == "click") & (F.col("value") >= 1) & (F.col("value") < 2)
    rows = table(spark, d, "events").select(
        F.when(spoiled, "0" * 20).otherwise(contracts.checkpoint_id(digest, none)).alias("checkpoint_id"), digest.alias("records_sha256"),
        F.sha2("props", 256).alias("source_manifest_sha256"), F.when(F.col("value") < 1, -1).otherwise(1).alias("record_count"), none.alias("parent_id"))
    return contracts.checkpoint_violations(rows)
