"""Column ids, budgets, canonical records, digests, projections, profiles, order, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import canon, lexical
from plumbline.operators import digest, integrity, ordering, profile, projection, readiness
from plumbline.plans.registry import (
    KINDS, query, sql_hash, sql_json, sql_multiset, sql_order, sql_record, sql_text_type, table)
from plumbline.sources import exports, readers

# ---- intake and sinks (A, S) ------------------------------------------------------------


@query("column_ids", """
with h as (select p_brand as "table", p_type as name, row_number() over (partition by p_brand order by p_partkey) - 1 as position
  from (select p_brand, p_type, min(p_partkey) as p_partkey from part group by p_brand, p_type, p_size)),
n as (select *, row_number() over (partition by "table", name order by position) as occ,
  count(*) over (partition by "table", name) as copies from h)
select 'col-' || substr(sha256('{"name":' || to_json(name)::varchar || ',"occurrence":' || occ || '}' || chr(10)),1,16) as column_id,
 "table", name, position::bigint as position, copies > 1 as duplicate_name from n""")
def column_ids(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("p_partkey"))
    headers = cells.select(
        F.col("p_brand").alias("table"), F.col("p_type").alias("name"),
        (F.expr("row_number() over (partition by p_brand order by p_partkey)") - 1).cast("long").alias("position"))
    return readers.column_specs_frame(headers)


@query("budget_violations", """
with f as (select max(octet_length(encode(text))) as longest, max(octet_length(encode(lang))) as l2,
  max(octet_length(encode(source))) as l3, count(*) as n,
  sum(octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source))) as total from documents)
select * from (
 select 'max_bytes' as budget, total::bigint as observed, 100000::bigint as allowed from f
 union all select 'max_columns', 5, 4 from f
 union all select 'max_field_bytes', greatest(longest, l2, l3)::bigint, 1000 from f
 union all select 'max_records', n::bigint, 1000000000000 from f) where observed > allowed""")
def budget_violations(spark: SparkSession, d: str) -> DataFrame:
    limits = {"max_bytes": 100_000, "max_columns": 4, "max_field_bytes": 1_000, "max_records": 10**12}
    return readers.budget_violations(table(spark, d, "documents"), limits)


_PATHS = "'docs/' || source || '/' || doc_id || case lang when 'en' then '.md' when 'de' then '.JSON' when 'fr' then '.csv' else '' end"


def document_paths(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".JSON").when(F.col("lang") == "fr", ".csv").otherwise("")
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return table(spark, d, "documents").withColumn("path", path)


@query("media_types", f"""
with p as (select {_PATHS} as path from documents),
m as (select case when path like '%.md' then 'text/markdown' when path like '%.JSON' then 'application/json'
 when path like '%.csv' then 'text/csv' else 'application/octet-stream' end as media_type from p)
select media_type, case media_type when 'text/csv' then 'TABLE' when 'application/json' then 'JSON'
 when 'text/markdown' then 'TEXT' else 'BINARY' end as media_family, count(*)::bigint as files from m group by 1,2""")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    media = document_paths(spark, d).select(integrity.media_type(F.col("path")).alias("media_type"))
    return media.groupBy("media_type", integrity.media_family(F.col("media_type")).alias("media_family")).agg(
        F.count(F.lit(1)).alias("files"))


@query("document_inventory", f"""
select {_PATHS} as relative_path, sha256(text) as sha256, octet_length(encode(text))::bigint as size from documents""")
def document_inventory(spark: SparkSession, d: str) -> DataFrame:
    return document_paths(spark, d).select(
        F.col("path").alias("relative_path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("finding_export", """
select c_custkey::varchar as c_custkey,
 case when regexp_matches(t, '^[=+@-]') then '''' || t else t end as note, case when regexp_matches(a, '^[=+@-]') then '''' || a else a end as tags
from (select c_custkey, case when c_mktsegment in ('BUILDING','MACHINERY') then '=' || c_name when c_acctbal < 0 then '-' || c_name
  else c_name end as t, c_mktsegment || '; ' || c_nationkey as a from customer)""")
def finding_export(spark: SparkSession, d: str) -> DataFrame:
    note = (
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.concat(F.lit("="), "c_name"))
        .when(F.col("c_acctbal") < 0, F.concat(F.lit("-"), "c_name")).otherwise(F.col("c_name")))
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"), note.alias("note"),
        F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"))
    return exports.flat_rows(rows)


@query("checksum_list", f"""
select sha256(text) || '  ' || ({_PATHS}) as line from documents order by {_PATHS}""")
def checksum_list(spark: SparkSession, d: str) -> DataFrame:
    return exports.checksum_lines(document_paths(spark, d).select("path", F.sha2("text", 256).alias("sha256")))


# ---- canonical form and digests (B) -----------------------------------------------------


def _record_query(name: str) -> None:
    columns = KINDS[name]
    key = next(iter(columns))

    @query(f"record_hashes_{name}", f"select {key}, {sql_hash(columns)} as record_sha256 from {name}")
    def build(spark: SparkSession, d: str) -> DataFrame:
        frame = table(spark, d, name)
        return frame.select(key, canon.record_hash(frame).alias("record_sha256"))

    @query(f"table_digest_{name}", f"with {sql_multiset(f'select {sql_hash(columns)} as h from {name}')} select * from multiset_")
    def fold(spark: SparkSession, d: str) -> DataFrame:
        return digest.multiset_digest(canon.record_hashes(table(spark, d, name)))


for _name in ("customer", "orders", "lineitem", "events", "documents", "pages", "conversations"):
    _record_query(_name)


@query("canonical_records", f"select n_nationkey, {sql_record(KINDS['nation'])} as canonical from nation")
def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    frame = table(spark, d, "nation")
    return frame.select("n_nationkey", canon.canonical_record(frame).alias("canonical"))


@query("order_digest_events", f"""
with {sql_order("select event_id as i, " + sql_hash(KINDS['events']) + " as d from events")} select * from order_""")
def order_digest_events(spark: SparkSession, d: str) -> DataFrame:
    frame = table(spark, d, "events")
    return digest.order_digest(frame.select("event_id", canon.record_hash(frame).alias("record_sha256")), "event_id")


_SNAPSHOT = "'{\"parent_generation_id\":' || coalesce('\"' || parent || '\"','null') || ',\"records_sha256\":\"' || h || '\"}' || chr(10)"


@query("stream_version_ids", f"""
with h as (select event_id, {sql_hash(KINDS['events'])} as h from events),
o as (select event_id // 1000 as block, sha256(string_agg(h, ',' order by event_id)) as h from h group by 1),
p as (select o.block, o.h, case when q.h is null then null else 'gen-' || substr(q.h,1,16) end as parent from o left join o q on q.block = o.block - 1)
select block::bigint as block, 'gen-' || substr(sha256({_SNAPSHOT}),1,16) as version_id from p""")
def stream_version_ids(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.contracts import checkpoint_id

    frame = table(spark, d, "events")
    hashed = frame.select("event_id", canon.record_hash(frame).alias("h"))
    blocks = hashed.groupBy(F.expr("event_id div 1000").alias("block")).agg(  # 1,000 events at most
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "h"))), lambda e: e["h"]), ","), 256).alias("h"))
    before = blocks.select((F.col("block") + 1).alias("block"), F.concat(F.lit("gen-"), F.substring("h", 1, 16)).alias("parent"))
    return blocks.join(before, "block", "left").select("block", checkpoint_id(F.col("h"), F.col("parent")).alias("version_id"))


@query("self_hash", f"select s_suppkey, s_name, s_nationkey, s_acctbal, {sql_hash(KINDS['supplier'])} as record_sha256 from supplier")
def self_hash(spark: SparkSession, d: str) -> DataFrame:
    return canon.bind_hash(table(spark, d, "supplier"))


@query("broken_self_hashes", """
select s_suppkey from supplier where s_acctbal < 0 or s_nationkey = 3""")
def broken_self_hashes(spark: SparkSession, d: str) -> DataFrame:
    bound = canon.bind_hash(table(spark, d, "supplier"))
    changed = bound.withColumn("s_name", F.when(F.col("s_nationkey") == 3, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    changed = changed.withColumn("s_acctbal", F.when(F.col("s_acctbal") < 0, F.col("s_acctbal") - 1).otherwise(F.col("s_acctbal")))
    return canon.broken_hashes(changed).select("s_suppkey")


@query("packet_ids", f"""
with {sql_multiset("select sha256(sha256(text) || '  ' || (" + _PATHS + ")) as h from documents")}
select 'revision-' || substr(records_sha256,1,16) as packet_id, row_count as file_count from multiset_""")
def packet_ids(spark: SparkSession, d: str) -> DataFrame:
    return integrity.packet_id("revision", document_paths(spark, d).select("path", F.sha2("text", 256).alias("sha256")))


# ---- projections and predicates (C) -----------------------------------------------------

_SHOWN = {"o_orderkey": "n", "o_totalprice": "n", "o_orderpriority": "s"}


@query("projection_with_hashes", f"""
select o_orderkey as ordinal, {sql_hash(KINDS['orders'])} as record_sha256, o_orderkey, o_totalprice, o_orderpriority,
 octet_length(encode({sql_record(_SHOWN)}))::bigint as shown_bytes from orders""")
def projection_with_hashes(spark: SparkSession, d: str) -> DataFrame:
    return projection.projected(table(spark, d, "orders"), list(_SHOWN), "o_orderkey")


@query("redacted_projection", f"""
select o_orderkey as ordinal, {sql_hash(KINDS['orders'])} as record_sha256, null::varchar as o_orderpriority, 0::bigint as shown_bytes
from orders""")
def redacted_projection(spark: SparkSession, d: str) -> DataFrame:
    return projection.projected(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", redact=True)


def document_references(spark: SparkSession, d: str) -> DataFrame:
    return document_paths(spark, d).select(
        F.col("doc_id").cast("string").alias("ref_id"), F.col("source").alias("role"),
        integrity.media_type(F.col("path")).alias("media_type"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2("text", 256).alias("sha256"), F.when(F.col("lang") == "de", "PRIVATE").otherwise("METADATA").alias("disclosure"))


@query("alias_references", """
select 'source-' || substr(sha256('{"export_id":"export-1","ref_id":' || to_json(doc_id::varchar)::varchar || '}' || chr(10)),1,16) as source_ref_alias,
 source as role, case lang when 'en' then 'TEXT' when 'fr' then 'TABLE' else 'BINARY' end as media_family,
 octet_length(encode(text))::bigint as size_bytes, sha256(text) as content_sha256, 'METADATA' as disclosure, 'METADATA_ONLY' as body_policy
from documents where lang <> 'de'""")
def alias_references(spark: SparkSession, d: str) -> DataFrame:
    return projection.public_references(document_references(spark, d), "export-1", 10**12)


@query("counts_only", """
select 'customer' as entity, count(*)::bigint as row_count, 'c_acctbal' as present_fields from customer
union all select 'documents', count(*), 'lang' from documents union all select 'orders', count(*), 'o_orderdate' from orders""")
def counts_only(spark: SparkSession, d: str) -> DataFrame:
    frames = {n: table(spark, d, n) for n in ("customer", "documents", "orders")}
    out = projection.counts_only(frames, {"customer": ["c_acctbal"], "documents": ["lang"], "orders": ["o_orderdate"]})
    return out.withColumn("present_fields", F.array_join("present_fields", ";"))


@query("value_predicates", r"""
with v as (select doc_id, x from (select doc_id, case lang when 'en' then text when 'de' then '' when 'fr' then '=SUM(' || source || ')'
  else sha256(text) end as x from documents))
select doc_id, coalesce(x,'')='' as missing,
 regexp_matches(x,'^[=+@-]') and not (regexp_matches(x,'^[+-]') and regexp_matches(x,'^[+-]?(?:[0-9]+\.[0-9]*|[0-9]*\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?$')) as formula_like,
 regexp_matches(x,'^[0-9a-f]{32,64}$') as hash_like from v""")
def value_predicates(spark: SparkSession, d: str) -> DataFrame:
    x = (
        F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", "")
        .when(F.col("lang") == "fr", F.concat(F.lit("=SUM("), "source", F.lit(")"))).otherwise(F.sha2("text", 256)))
    rows = table(spark, d, "documents").select("doc_id", x.alias("x"))
    return rows.select("doc_id", canon.is_missing(F.col("x"), rows.schema["x"].dataType).alias("missing"),
                       lexical.formula_like(F.col("x")).alias("formula_like"), lexical.looks_like_hash(F.col("x")).alias("hash_like"))


_FILL = """
with recursive r as (
 select conv_id, turn, row_number() over (partition by conv_id order by turn) as n, 40 as meta_bytes,
  40 + octet_length(encode(text)) as full_bytes from conversations),
w as (select conv_id, turn, n, meta_bytes, full_bytes, full_bytes <= 2000 as kept,
   case when full_bytes <= 2000 then full_bytes else meta_bytes end as used from r where n = 1
 union all select r.conv_id, r.turn, r.n, r.meta_bytes, r.full_bytes, w.used + r.full_bytes <= 2000,
   w.used + case when w.used + r.full_bytes <= 2000 then r.full_bytes else r.meta_bytes end
  from w join r on r.conv_id = w.conv_id and r.n = w.n + 1)
select conv_id as packet, turn as position, meta_bytes::bigint as meta_bytes, full_bytes::bigint as full_bytes, kept,
 max(used) over (partition by conv_id) > 2000 as refused from w"""


@query("packet_fill", _FILL)
def packet_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("packet"), F.col("turn").alias("position"), F.lit(40).cast("long").alias("meta_bytes"),
        (F.octet_length("text") + 40).cast("long").alias("full_bytes"))
    return projection.fill_packets(rows, 2000)


# ---- profiles (D) -----------------------------------------------------------------------


def sql_profile(name: str) -> str:
    parts = []
    for place, (column, kind) in enumerate(KINDS[name].items()):
        integer = kind == "n" and column not in (
            "c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value")
        vtype = {"t": "'DATETIME'", "n": "'INTEGER'" if integer else "'NUMBER'"}.get(kind, sql_text_type(column))
        missing = f"coalesce({column},'')=''" if kind == "s" else f"{column} is null"
        formula = (
            f"(select bool_or(coalesce(regexp_matches({column},'^[=+@-]') and not (regexp_matches({column},'^[+-]') and "
            f"{sql_text_type(column)} in ('INTEGER','NUMBER')),false)) from {name})" if kind == "s" else "false")
        parts.append(f"""select {place} as position, '{column}' as name,
 case when count(distinct t) = 0 then 'NULL' when count(distinct t) = 1 then max(t)
  when count(distinct t) = 2 and min(t) = 'INTEGER' and max(t) = 'NUMBER' then 'NUMBER' else 'MIXED' end as observed_type,
 count(*)::bigint as row_count, count_if(m)::bigint as null_count, count(distinct v)::bigint as distinct_count,
 count_if(m) = 0 and count(distinct v) = count(*) as candidate_key, max(f) as formula_like
 from (select {missing} as m, case when not ({missing}) then {vtype} end as t, case when not ({missing}) then {column} end as v,
  {formula} as f from {name})""")
    return "\nunion all ".join(parts)


def _profile_query(name: str) -> None:
    @query(f"column_profile_{name}", sql_profile(name))
    def build(spark: SparkSession, d: str) -> DataFrame:
        return profile.column_profile(table(spark, d, name))


for _name in ("orders", "customer", "part", "events", "lineitem", "documents", "labels"):
    _profile_query(_name)


@query("value_types", f"select doc_id, {sql_text_type('x')} as value_type from (select doc_id, case lang when 'de' then n_chars::varchar "
       "when 'fr' then n_chars || '.5' when 'es' then '2024-02-' || lpad((n_chars % 40)::varchar, 2, '0') else text end as x from documents)")
def value_types(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    x = (
        F.when(F.col("lang") == "de", n.cast("string")).when(F.col("lang") == "fr", F.concat(n.cast("string"), F.lit(".5")))
        .when(F.col("lang") == "es", F.concat(F.lit("2024-02-"), F.lpad((n % 40).cast("string"), 2, "0"))).otherwise(F.col("text")))
    return table(spark, d, "documents").select("doc_id", lexical.text_type(x).alias("value_type"))


@query("exact_duplicate_rows", """
select coalesce(sum(n - 1),0)::bigint as exact_duplicate_row_count from (select count(*) as n from documents group by text, lang, source, n_chars)""")
def exact_duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return profile.exact_duplicates(table(spark, d, "documents").drop("doc_id"))


@query("anomaly_queue_lineitem", """
select 'LEAD' as classification, 'NO_CANDIDATE_KEY' as code,
 'No single complete unique column was observed; record identity remains user-declared.' as message
from (select count(*) as n, greatest(count(distinct l_orderkey), count(distinct l_partkey), count(distinct l_suppkey),
 count(distinct l_linenumber), count(distinct l_quantity), count(distinct l_extendedprice), count(distinct l_discount), count(distinct l_tax),
 count(distinct l_returnflag), count(distinct l_linestatus), count(distinct l_shipdate)) as best from lineitem) where best < n
union all select 'CANDIDATE', 'EXACT_DUPLICATE_ROWS', 'Exact duplicate records are present and remain preserved.'
from (select 1 from (select distinct * from lineitem) having count(*) < (select count(*) from lineitem))""")
def anomaly_queue_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return profile.anomalies(table(spark, d, "lineitem"))


@query("anomaly_queue_documents", """
with x as (select case lang when 'fr' then '=' || source when 'de' then n_chars::varchar else 'text' end as cell, source from documents)
select 'CANDIDATE' as classification, 'EXACT_DUPLICATE_ROWS' as code, 'Exact duplicate records are present and remain preserved.' as message
 from (select count(*) as g from (select cell from x group by cell, source having count(*) > 1)) where g > 0
union all select 'CANDIDATE', 'MIXED_LEXICAL_TYPES', 'One column contains multiple lexical or structural type candidates.'
 from (select count_if(regexp_matches(cell,'^[0-9]+$')) as i, count(*) as n from x) where i > 0 and i < n
union all select 'LEAD', 'FORMULA_LIKE_TEXT_PRESERVED', 'Formula-like text was preserved without execution and requires review before spreadsheet export.'
 from (select count_if(cell like '=%') as f from x) where f > 0
union all select 'LEAD', 'NO_CANDIDATE_KEY', 'No single complete unique column was observed; record identity remains user-declared.'
 from (select count(distinct cell) as a, count(distinct source) as b, count(*) as n from x) where a < n and b < n""")
def anomaly_queue_documents(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(F.col("lang") == "fr", F.concat(F.lit("="), "source")).when(
        F.col("lang") == "de", F.col("n_chars").cast("string")).otherwise("text")
    return profile.anomalies(table(spark, d, "documents").select(cell.alias("cell"), "source"))


@query("sampled_datetime_ratio", """
with h as (select strftime(ts,'%Y-%m-%d %H:%M:%S.%f') as ts, event_type from events)
select 'ts' as name, count(*)::bigint as seen, count_if(try_strptime(substr(ts,1,10),'%Y-%m-%d') is not null)::bigint as parsed,
 count_if(try_strptime(substr(ts,1,10),'%Y-%m-%d') is not null) / count(*) as datetime_ratio, false as hash_like from h
union all select 'event_type', count(*), 0, 0.0, false from h""")
def sampled_datetime_ratio(spark: SparkSession, d: str) -> DataFrame:
    return profile.sampled_datetime_ratio(table(spark, d, "events"), "event_id", ["ts", "event_type"])


@query("sampled_unique_ratio", """
select count(*)::bigint as rows, count(distinct (user_id, event_type))::bigint as distinct_keys,
 count(distinct (user_id, event_type)) / count(*) as unique_ratio from events""")
def sampled_unique_ratio(spark: SparkSession, d: str) -> DataFrame:
    return profile.sampled_unique_ratio(table(spark, d, "events"), "event_id", ["user_id", "event_type"])


@query("column_roles_events", """
select * from (values ('event_id', 0, 'entity'), ('event_id', 0, 'sequence'), ('ts', 1, 'timestamp'), ('user_id', 2, 'entity'),
 ('event_type', 3, 'sequence')) v(name, position, role)""")
def column_roles_events(spark: SparkSession, d: str) -> DataFrame:
    return profile.classify_columns(table(spark, d, "events"), "event_id").filter("role <> 'hash'")


@query("sort_plan_events", """
select 'time_series' as detected_kind, 'PROPOSAL' as gate_status, 'event_id,ts' as primary_keys, '' as tie_break_keys""")
def sort_plan_events(spark: SparkSession, d: str) -> DataFrame:
    plan = profile.propose_sort_plan(table(spark, d, "events"), "event_id")
    return plan.select("detected_kind", "gate_status", F.array_join("primary_keys", ",").alias("primary_keys"),
                       F.array_join("tie_break_keys", ",").alias("tie_break_keys"))


# ---- order (E) --------------------------------------------------------------------------


def sql_runs(name: str, keys: list[str], nulls: str = "last") -> str:
    tokens = ", ".join(f"{sql_json(k, KINDS[name][k])} as k{i}" for i, k in enumerate(keys))
    group = ", ".join(f"k{i}" for i in range(len(keys)))
    return f"""runs_ as (select {group}, h, count(*) as copies from (select {tokens}, {sql_hash(KINDS[name])} as h from {name}) group by {group}, h),
seq_ as (select h, copies, row_number() over (order by {group}, h) - 1 as i,
 sum(copies) over (order by {group}, h rows between unbounded preceding and current row) - copies as position from runs_)"""


def _order_query(name: str, keys: list[str]) -> None:
    @query(f"total_order_{name}", f"with {sql_runs(name, keys)} select h as record_sha256, copies::bigint as copies, position::bigint as position from seq_")
    def runs(spark: SparkSession, d: str) -> DataFrame:
        frame = table(spark, d, name)
        return ordering.ordered_runs(frame, ordering.make_sort_spec(frame, keys))

    @query(f"normalised_digest_{name}", f"with {sql_runs(name, keys)}, {sql_order('select i, h || chr(42) || copies as d from seq_')} select * from order_")
    def fold(spark: SparkSession, d: str) -> DataFrame:
        frame = table(spark, d, name)
        return ordering.normalised_digest(frame, ordering.make_sort_spec(frame, keys))


for _name, _keys in (("supplier", ["s_nationkey", "s_name"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("labels", ["quality", "toxic"])):
    _order_query(_name, _keys)


@query("sorted_nation", f"""
select n_nationkey, n_name, n_regionkey, {sql_hash(KINDS['nation'])} as record_sha256 from nation
order by n_regionkey::varchar, n_name""")
def sorted_nation(spark: SparkSession, d: str) -> DataFrame:
    frame = table(spark, d, "nation")
    return ordering.in_total_order(frame, ordering.make_sort_spec(frame, ["n_regionkey"], ["n_name"]))


@query("null_order", """
select doc_id, row_number() over (order by case when lang = 'de' then 0 else 1 end, case when lang = 'de' then '' else '"' || source || '"' end, doc_id::varchar) - 1 as position
from documents""")
def null_order(spark: SparkSession, d: str) -> DataFrame:
    frame = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias("source"))
    spec = ordering.make_sort_spec(frame, ["source", "doc_id"], nulls="nulls_first")
    placed = digest.with_positions(ordering.tokenised(frame, spec, ("doc_id",)), [F.col("_order")])
    return placed.select("doc_id", "position")


@query("lane_sort_supplier", f"""
select s_suppkey, s_name, s_nationkey, s_acctbal, {sql_hash(KINDS['supplier'])} as record_sha256 from supplier order by s_nationkey::varchar, lower(s_name)""")
def lane_sort_supplier(spark: SparkSession, d: str) -> DataFrame:
    return ordering.lane_sort(table(spark, d, "supplier"), ["s_nationkey"], ["s_name"])


@query("order_dependent_groups", f"""
select l_orderkey::varchar as k0, l_linenumber::varchar as k1, count(distinct h)::bigint as distinct_records, count(*)::bigint as records
from (select *, {sql_hash(KINDS['lineitem'])} as h from lineitem) group by 1,2 having count(distinct h) > 1""")
def order_dependent_groups(spark: SparkSession, d: str) -> DataFrame:
    return ordering.order_dependent_groups(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- readiness (F) ----------------------------------------------------------------------


def sql_checks(name: str, keys: list[str], policy: str = "block") -> str:
    group = ", ".join(keys)
    rows = []
    for place, check in enumerate(readiness.REQUIRED_CHECKS):
        if check in ("duplicate_handling", "join_keys_and_cardinality"):
            status = "'PASS'" if policy == "exact" else "case when dup = 0 then 'PASS' else 'FAIL' end"
        elif check in ("order_invariance", "row_reconciliation"):
            status = "case when n > 0 then 'PASS' else 'FAIL' end"
        elif check in ("source_identity", "independent_verification"):
            status = "'FAIL'"  # a bare table is bound to nothing and verified by nobody
        else:
            status = "'PASS'"
        rows.append(f"select {place} as position, '{check}' as check_id, {status} as status from f")
    return (f"with g as (select count(*) as c from {name} group by {group}), f as (select coalesce(sum(c),0) as n, count_if(c > 1) as dup from g)\n"
            + "\nunion all ".join(rows))


def _ready(name: str, label: str, keys: list[str], policy: str = "block") -> None:
    @query(f"readiness_checks_{label}", sql_checks(name, keys, policy))
    def checks(spark: SparkSession, d: str) -> DataFrame:
        frame = table(spark, d, name)
        spec = ordering.make_sort_spec(frame, keys, duplicate_policy=policy)
        return readiness.readiness_checks(frame, spec).select("position", "check_id", "status")

    @query(f"readiness_decision_{label}", "with c as (" + sql_checks(name, keys, policy) + """)
select count_if(status='PASS')::bigint as passed, count_if(status='FAIL')::bigint as failed, count_if(status='BLOCKED')::bigint as blocked,
 case when count_if(status='BLOCKED')>0 then 'BLOCKED' when count_if(status='FAIL')>0 then 'FAIL' else 'PASS' end as decision,
 sha256(string_agg(lpad(position::varchar,2,'0') || '=' || check_id || '=' || status, ',' order by position)) as binding_sha256 from c""")
    def decision(spark: SparkSession, d: str) -> DataFrame:
        frame = table(spark, d, name)
        return readiness.readiness_decision(readiness.readiness_checks(frame, ordering.make_sort_spec(frame, keys, duplicate_policy=policy)))


_ready("events", "events", ["event_id"])
_ready("lineitem", "lineitem", ["l_orderkey", "l_linenumber"])
_ready("lineitem", "lineitem_exact", ["l_orderkey", "l_linenumber"], "exact")


@query("key_counts_lineitem", """
select sum(c)::bigint as row_count, count(*)::bigint as key_groups, count_if(c > 1)::bigint as duplicate_key_count,
 coalesce(sum(case when c > 1 then c end),0)::bigint as rows_in_duplicate_groups, 0::bigint as null_key_cells
from (select count(*) as c from lineitem group by l_orderkey, l_linenumber)""")
def key_counts_lineitem(spark: SparkSession, d: str) -> DataFrame:
    frame = table(spark, d, "lineitem")
    return readiness.key_counts(frame, ordering.make_sort_spec(frame, ["l_orderkey", "l_linenumber"]))


@query("missing_keys_blocked", """
with k as (select case when lang = 'de' then null else doc_id end as key from documents)
select 'missingness' as check_id, case when count_if(key is null) > 0 then 'BLOCKED' else 'PASS' end as status,
 count_if(key is null)::bigint as null_key_cells from k""")
def missing_keys_blocked(spark: SparkSession, d: str) -> DataFrame:
    frame = table(spark, d, "documents").select(F.when(F.col("lang") != "de", F.col("doc_id")).alias("key"), "text")
    spec = ordering.make_sort_spec(frame, ["key"], nulls="nulls_error")
    checks = readiness.readiness_checks(frame, spec).filter("check_id = 'missingness'")
    return checks.select("check_id", "status", F.col("evidence")["null_key_cells"].cast("long").alias("null_key_cells"))


@query("readiness_states", """
with r as (select c_custkey as dataset, c_nationkey as n, c_acctbal as b, c_mktsegment as m from customer)
select dataset::varchar as dataset, case when m = 'BUILDING' then 'NONE' when m = 'FURNITURE' then 'AMBIGUOUS' when b < 0 then 'TAMPERED'
 when n < 5 then 'STALE' when n < 15 then 'PASS' else 'FAIL' end as state from r""")
def readiness_states(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("dataset"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b"),
        F.col("c_mktsegment").alias("m"))
    receipts = c.filter("m <> 'BUILDING'").select(
        "dataset", F.concat(F.lit("r"), "dataset").alias("receipt_id"), F.when(F.col("n") < 5, "old").otherwise("now").alias("records_sha256"),
        F.when(F.col("n") < 15, "PASS").otherwise("FAIL").alias("decision"), (F.col("b") >= 0).alias("intact"))
    doubled = receipts.join(c.filter("m = 'FURNITURE'").select("dataset"), "dataset", "left_semi").withColumn(
        "receipt_id", F.concat("receipt_id", F.lit("b")))
    active = receipts.unionByName(doubled).select("dataset", "receipt_id")
    current = c.select("dataset", F.lit("now").alias("records_sha256"))
    return readiness.readiness_status(receipts.unionByName(doubled), active, current).select("dataset", "state")
