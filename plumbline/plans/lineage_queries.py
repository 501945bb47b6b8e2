"""Deltas, reconciliation, manifests, references, chains and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.canon import key_hash, record_hash
from plumbline.operators import contracts, delta, evidence, integrity
from plumbline.plans.registry import KINDS, query, sql_hash, table
from plumbline.session import checkpoint_dir, freeze, tasks_for
from plumbline.sources import versions

# ---- two versions of orders -------------------------------------------------------------
# The right version drops, changes, unkeys, repeats and adds orders by their priority and
# status, so every class of the delta has rows at every scale.

_KEPT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_DELTA_KINDS = {k: KINDS["orders"][k] for k in _KEPT}


def order_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, d, "orders").select(*_KEPT, F.col("o_orderkey").alias("ordinal"))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kept = left.filter(~((p == "5-LOW") & (s == "P")))
    changed = kept.withColumns({
        "o_totalprice": F.when((p == "2-HIGH") & (s == "F"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderkey": F.when((p == "3-MEDIUM") & (s == "P"), F.lit(None)).otherwise(F.col("o_orderkey")),
        "ordinal": F.col("ordinal") * 3,
    })
    repeated = left.filter((p == "1-URGENT") & (s == "O")).withColumn("ordinal", F.col("ordinal") * 3 + 1)
    repeated = repeated.withColumn("o_totalprice", F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice") + 2).otherwise(F.col("o_totalprice")))
    added = left.filter((p == "4-NOT SPECIFIED") & (s == "P")).withColumns({
        "o_orderkey": -1 - F.col("o_orderkey"), "ordinal": F.col("ordinal") * 3 + 2})
    return left, changed.unionByName(repeated).unionByName(added)


_VERSIONS = """
left_ as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderkey as ordinal from orders),
right_ as (
 select case when o_orderpriority='3-MEDIUM' and o_orderstatus='P' then null else o_orderkey end as o_orderkey, o_custkey, o_orderstatus,
  case when o_orderpriority='2-HIGH' and o_orderstatus='F' then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderpriority, ordinal*3 as ordinal
  from left_ where not (o_orderpriority='5-LOW' and o_orderstatus='P')
 union all select o_orderkey, o_custkey, o_orderstatus, case when o_totalprice > 250000 then o_totalprice + 2 else o_totalprice end, o_orderpriority, ordinal*3+1
  from left_ where o_orderpriority='1-URGENT' and o_orderstatus='O'
 union all select -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, ordinal*3+2 from left_ where o_orderpriority='4-NOT SPECIFIED' and o_orderstatus='P')"""
_HASHED = f"""{_VERSIONS},
lh as (select *, {sql_hash(_DELTA_KINDS)} as h from left_), rh as (select *, {sql_hash(_DELTA_KINDS)} as h from right_),
lg as (select o_orderkey as k, count(*) as n, list_sort(list(h)) as hs from lh where o_orderkey is not null group by 1),
rg as (select o_orderkey as k, count(*) as n, list_sort(list(h)) as hs from rh where o_orderkey is not null group by 1),
g as (select coalesce(lg.k, rg.k) as k, coalesce(lg.n,0) as nl, coalesce(rg.n,0) as nr, lg.hs as hl, rg.hs as hr from lg full outer join rg on lg.k = rg.k),
c as (select *, case when nl > 1 or nr > 1 then 'CANDIDATE_DUPLICATE' when nl = 0 then 'ADDED' when nr = 0 then 'ABSENT'
  when hl = hr then 'UNCHANGED' else 'MODIFIED' end as class, nl > 0 and nr > 0 and hl <> hr as conflict from g)"""


@query("delta_summary", f"""with {_HASHED},
x as (select least(a.n, b.n) as n from (select h, count(*) as n from lh group by h) a join (select h, count(*) as n from rh group by h) b on a.h = b.h),
u as (select (select count(*) from lh where o_orderkey is null) + (select count(*) from rh where o_orderkey is null) as n)
select (select coalesce(sum(n),0) from x)::bigint as exact_duplicate_count, count_if(class='CANDIDATE_DUPLICATE')::bigint as candidate_duplicate_count,
 count_if(conflict)::bigint as conflict_count, count_if(conflict)::bigint as preserved_conflict_count, count_if(class='ADDED')::bigint as added_count,
 count_if(class='ABSENT')::bigint as absent_count, count_if(class='MODIFIED')::bigint as modified_count, count_if(class='UNCHANGED')::bigint as unchanged_count,
 ((select n from u) + count_if(class='CANDIDATE_DUPLICATE'))::bigint as unknown_count, (select n from u)::bigint as missing_key_rows,
 count_if(class='CANDIDATE_DUPLICATE')::bigint as duplicate_key_groups from c""")
def delta_summary(spark: SparkSession, d: str) -> DataFrame:
    left, right = order_versions(spark, d)
    return delta.delta_summary(delta.hashed_sides(left, right, ["o_orderkey"], "ordinal"))


_KEY = "sha256('[' || to_json(o_orderkey::varchar || chr(10))::varchar || ']' || chr(10))"


@query("delta_ledger", f"""with {_HASHED},
r as (select 'LEFT' as side, ordinal, h, o_orderkey from lh union all select 'RIGHT', ordinal, h, o_orderkey from rh)
select side, ordinal, r.h as source_record_sha256, case when o_orderkey is not null then {_KEY} end as key_sha256, coalesce(class,'UNKNOWN') as classification,
 case when o_orderkey is null then 0 when side='LEFT' then nr else nl end::bigint as counterpart_count,
 case when o_orderkey is null then 0 when side='LEFT' then len(list_filter(coalesce(hr,[]), lambda y: y = r.h)) else len(list_filter(coalesce(hl,[]), lambda y: y = r.h)) end::bigint as exact_counterpart_count,
 coalesce(conflict, false) as conflict, true as preserved
from r left join c on r.o_orderkey = c.k""")
def delta_ledger(spark: SparkSession, d: str) -> DataFrame:
    left, right = order_versions(spark, d)
    return delta.delta_ledger(delta.hashed_sides(left, right, ["o_orderkey"], "ordinal"))


@query("key_hashes", f"select o_custkey, {_KEY} as key_sha256 from orders")
def key_hashes(spark: SparkSession, d: str) -> DataFrame:
    frame = table(spark, d, "orders")
    return frame.select("o_custkey", key_hash(frame, ["o_orderkey"]).alias("key_sha256"))


@query("exact_matches", f"""with {_VERSIONS},
a as (select {sql_hash(_DELTA_KINDS)} as h from left_), b as (select {sql_hash(_DELTA_KINDS)} as h from right_)
select count(*)::bigint as exact_matches from (select h from a intersect all select h from b)""")
def exact_matches(spark: SparkSession, d: str) -> DataFrame:
    left, right = (s.select(record_hash(s, _KEPT).alias("h")) for s in order_versions(spark, d))
    return delta.exact_matches(left, right)


@query("reconciled_rows", f"""with {_VERSIONS}
select *, 'LEFT' as side, 0 as side_order, null::varchar as review from left_
union all select *, 'RIGHT', 1, o_orderstatus || '!' from right_""")
def reconciled_rows(spark: SparkSession, d: str) -> DataFrame:
    left, right = order_versions(spark, d)
    return delta.reconcile(left, right.withColumn("review", F.concat("o_orderstatus", F.lit("!"))), ["o_orderkey"], "ordinal")


def _store(spark: SparkSession) -> versions.VersionStore:
    return versions.VersionStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}")


@query("reconciled_version", f"""with {_VERSIONS}
select ordinal, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, null::varchar as review, 2::bigint as parents, 'annotated;priced' as annotations, 'a;b;c' as sources from left_
union all select ordinal + (select max(ordinal) + 1 from left_), o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderstatus || '!', 2, 'annotated;priced', 'a;b;c' from right_""")
def reconciled_version(spark: SparkSession, d: str) -> DataFrame:
    """Two published versions of orders reconciled into a third: its stored records and what its manifest merged."""
    left, right = order_versions(spark, d)
    store = _store(spark)
    first = store.publish(left, "CSV", ["b", "a"], annotations=["priced"])
    second = store.publish(right.withColumn("review", F.concat("o_orderstatus", F.lit("!"))), "CSV", ["c", "a"], annotations=["annotated", "priced"])
    third = store.reconcile(first, second, ["o_orderkey"])
    bound = store.manifests().filter(F.col("snapshot_id") == third).select(
        F.size("parents").cast("long").alias("parents"), F.array_join("annotations", ";").alias("annotations"), F.array_join("sources", ";").alias("sources"))
    return store.load(third).drop("record_sha256").join(F.broadcast(bound))


@query("lineage_verification", """
with changed as (select count(*) as n from orders where o_orderstatus = 'P' and o_orderpriority = '2-HIGH')
select 'second' as version, unnest(['RECORD_HASH', 'RECORDS_DIGEST', 'ORDER_DIGEST', 'IDENTITY']) as problem from changed where n > 0
union all select 'fourth', 'PARENT_MISSING' from changed""")
def lineage_verification(spark: SparkSession, d: str) -> DataFrame:
    """Four versions of orders, one of them tampered with after it was published and one with an unknown parent, checked in one job."""
    orders = table(spark, d, "orders").select(*_KEPT, F.col("o_orderkey").alias("ordinal"))
    store = _store(spark)
    first = store.publish(orders.filter("o_orderstatus = 'F'"), "CSV", ["a"])
    second = store.publish(orders.filter("o_orderstatus = 'P'"), "CSV", ["b"], [first])
    third = store.reconcile(first, second, ["o_orderkey"])
    fourth = store.publish(orders.filter("o_orderstatus = 'O'"), "JSONL", ["c"], [third, "snap-unknown"])
    path = store.manifest(second)["records_path"]
    dearer = F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    freeze(spark.read.parquet(path).withColumn("o_totalprice", dearer)).write.mode("overwrite").parquet(path)
    named = F.when(F.col("snapshot_id") == second, "second").when(F.col("snapshot_id") == third, "third").when(F.col("snapshot_id") == fourth, "fourth").otherwise("first")
    return store.verify_lineage(fourth).select(named.alias("version"), "problem")


@query("delta_entry_contract", """select 'LEFT/' || o_orderkey as subject, '/classification' as pointer, 'ENUM' as problem from orders where false""")
def delta_entry_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.delta_entry_violations(delta_ledger(spark, d))


@query("changed_ids", """
with b as (select c_custkey, c_name, case when c_nationkey = 7 then 8 else c_nationkey end as c_nationkey, c_acctbal, c_mktsegment from customer where c_mktsegment <> 'FURNITURE' or c_acctbal > 0
 union all select -1 - c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_nationkey = 3)
select coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when a.c_custkey is null then 'ADDED' when b.c_custkey is null then 'REMOVED' else 'CHANGED' end as change
from customer a full outer join b on a.c_custkey = b.c_custkey where a.c_custkey is null or b.c_custkey is null or a.c_nationkey <> b.c_nationkey""")
def changed_ids(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer")
    b = a.filter("c_mktsegment <> 'FURNITURE' or c_acctbal > 0").withColumn(
        "c_nationkey", F.when(F.col("c_nationkey") == 7, 8).otherwise(F.col("c_nationkey")))
    b = b.unionByName(a.filter("c_nationkey = 3").withColumn("c_custkey", -1 - F.col("c_custkey")))
    return delta.changed_ids(a, b, "c_custkey")


@query("id_sets", """
select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'OBSERVED_ONLY' when b.doc_id is null then 'EXPECTED_ONLY' else 'BOTH' end as membership
from (select doc_id from labels where quality = 1) a full outer join (select doc_id from labels where toxic = 1) b on a.doc_id = b.doc_id""")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return delta.id_sets(labels.filter("quality = 1"), labels.filter("toxic = 1"), "doc_id")


# ---- manifests and references -----------------------------------------------------------


def document_manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A recorded manifest of the documents and the present files, which lost, gained and
    changed some."""
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("size"), F.lit("text/markdown").alias("media_type"), "source")
    recorded = docs.filter("source <> 'src1'")
    recorded = recorded.unionByName(docs.filter("source = 'src2'"))
    actual = docs.filter("source <> 'src3'").withColumns({
        "sha256": F.when(F.col("source") == "src4", F.sha2("sha256", 256)).otherwise(F.col("sha256")),
        "size": F.when(F.col("source").isin("src4", "src5"), F.col("size") + 1).otherwise(F.col("size")),
        "media_type": F.when(F.col("source") == "src6", "text/plain").otherwise(F.col("media_type"))})
    return recorded, actual


@query("manifest_errors", """
with d as (select 'd/' || doc_id || '.md' as relative_path, source from documents)
select 'SOURCE_UNEXPECTED' as code, relative_path from d where source='src1'
union all select 'MANIFEST_DUPLICATE', relative_path from d where source='src2' union all select 'SOURCE_MISSING', relative_path from d where source='src3'
union all select 'SOURCE_DIGEST', relative_path from d where source='src4' union all select 'SOURCE_SIZE', relative_path from d where source in ('src4','src5')
union all select 'SOURCE_MEDIA_TYPE', relative_path from d where source='src6'""")
def manifest_errors(spark: SparkSession, d: str) -> DataFrame:
    recorded, actual = document_manifests(spark, d)
    return integrity.manifest_errors(recorded, actual)


@query("packet_errors", """
with d as (select 'd/' || doc_id || '.md' as path, source from documents where source <> 'src1')
select 'FILE_MISSING' as code, path from d where source='src3' union all select 'FILE_HASH', path from d where source='src4'
union all select 'FILE_SIZE', path from d where source in ('src4','src5') union all select 'CHECKSUM_LIST', path from d where source='src7'""")
def packet_errors(spark: SparkSession, d: str) -> DataFrame:
    recorded, actual = document_manifests(spark, d)
    packet = recorded.distinct().withColumnRenamed("relative_path", "path")
    sums = packet.filter("source <> 'src7'").select("path", "sha256")
    return integrity.packet_errors(packet.drop("source"), actual.withColumnRenamed("relative_path", "path"), sums)


@query("reference_states", """
select doc_id, case source when 'src3' then 'MISSING' when 'src4' then 'STALE_HASH' when 'src5' then 'STALE_SIZE' when 'src6' then 'WRONG_TYPE' else 'CURRENT' end as reference_state
from documents where source <> 'src1'""")
def reference_states(spark: SparkSession, d: str) -> DataFrame:
    recorded, actual = document_manifests(spark, d)
    states = integrity.reference_states(recorded.distinct(), actual)
    return states.select(F.regexp_extract("relative_path", "d/([0-9]+)", 1).cast("long").alias("doc_id"), "reference_state")


@query("unknown_references", """
select l_orderkey as subject, l_suppkey as reference from lineitem where l_suppkey not in (select n_nationkey from nation) group by 1,2""")
def unknown_references(spark: SparkSession, d: str) -> DataFrame:
    return integrity.unknown_references(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "nation"), "l_suppkey", "n_nationkey")


@query("order_customer_references", """
select o_orderkey as subject, o_custkey as reference from orders where o_custkey not in (select c_custkey from customer)""")
def order_customer_references(spark: SparkSession, d: str) -> DataFrame:
    return integrity.unknown_references(table(spark, d, "orders"), "o_orderkey", table(spark, d, "customer"), "o_custkey", "c_custkey")


@query("duplicate_ids", "select l_orderkey, l_linenumber, count(*)::bigint as copies from lineitem group by 1,2 having count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("role_index", """
select s_nationkey as role, s_suppkey as id, 1::bigint as copies, (count(*) over (partition by s_nationkey))::bigint as ids_in_role from supplier""")
def role_index(spark: SparkSession, d: str) -> DataFrame:
    return integrity.role_index(table(spark, d, "supplier"), "s_nationkey", "s_suppkey")


# ---- chains -----------------------------------------------------------------------------


def event_chain(spark: SparkSession, d: str) -> DataFrame:
    """All events as one chain; error events carry a wrong predecessor hash and signups whose
    value is under 5 are lost."""
    e = table(spark, d, "events")
    body = e.select(F.lit("all").alias("chain"), (F.col("event_id") + 1).alias("sequence"), "event_type", "value",
                    F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"), 256).alias("event_sha256"))
    before = body.select((F.col("sequence") + 1).alias("sequence"), F.col("event_sha256").alias("_b"))
    previous = F.when(F.col("sequence") == 1, integrity.ZERO_HASH).when(
        F.col("event_type") == "error", F.sha2("event_sha256", 256)).otherwise(F.col("_b"))
    tasks = tasks_for(e)
    linked = body.repartition(tasks, "sequence").join(before.repartition(tasks, "sequence").hint("merge"), "sequence", "left").withColumn("previous_event_sha256", previous)
    return linked.filter("not (event_type = 'signup' and value < 5)").drop("_b", "value")


_CHAIN = """
e as (select 'all' as chain, event_id + 1 as sequence, event_type, value, sha256(event_id || '|' || event_type || '|' || props) as h from events),
l as (select *, case when sequence = 1 then repeat('0',64) when event_type = 'error' then sha256(h) else lag(h) over (order by sequence) end as prev from e),
k as (select *, lag(sequence) over (order by sequence) as ps, lag(h) over (order by sequence) as ph from l where not (event_type='signup' and value < 5))"""


@query("chain_breaks", f"""with {_CHAIN}
select chain, sequence, case when sequence = 1 then 'START_HASH' when ps is null or ps <> sequence - 1 then 'SEQUENCE_GAP' else 'PREVIOUS_HASH' end as problem
from k where (sequence = 1 and prev <> repeat('0',64)) or (sequence > 1 and (ps is null or ps <> sequence - 1 or prev <> ph))""")
def chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    return integrity.chain_breaks(event_chain(spark, d), tasks=tasks_for(table(spark, d, "events")))


@query("chain_append", """
with recursive e as (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from conversations),
w as (select conv_id, n, text, repeat('0',64) as previous_event_sha256, sha256('{"payload":' || to_json(text)::varchar || ',"previous_event_sha256":"' || repeat('0',64) || '","sequence":1}' || chr(10)) as h from e where n = 1
 union all select e.conv_id, e.n, e.text, w.h, sha256('{"payload":' || to_json(e.text)::varchar || ',"previous_event_sha256":"' || w.h || '","sequence":' || e.n || '}' || chr(10)) from w join e on e.conv_id = w.conv_id and e.n = w.n + 1)
select conv_id as chain, n::bigint as sequence, previous_event_sha256, h as event_sha256 from w""")
def chain_append(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "conversations").select(
        F.col("conv_id").alias("chain"), F.col("turn").alias("batch_order"), F.col("text").alias("payload"))
    heads = batch.select("chain", F.lit(0).cast("long").alias("sequence"), F.lit(None).cast("string").alias("event_sha256")).limit(0)
    return integrity.append_chain(heads, batch).select("chain", "sequence", "previous_event_sha256", "event_sha256")


@query("transform_breaks", """
with s as (select conv_id as chain, turn as step_index, sha256(text) as out, role from conversations),
t as (select *, lead(case when role='assistant' and length(out) > 0 and substr(out,1,1) in ('0','1','2','3') then sha256(out) end) over (partition by chain order by step_index) as bad,
 lead(step_index) over (partition by chain order by step_index) as nx from s)
select chain, step_index, out as current_output_sha256, bad as next_input_sha256 from t where nx is not null and bad is not null""")
def transform_breaks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("chain"), F.col("turn").alias("step_index"), F.sha2("text", 256).alias("output_sha256"), "role")
    before = c.select("chain", (F.col("step_index") + 1).alias("step_index"), F.col("output_sha256").alias("_o"))
    wrong = (F.col("role") == "assistant") & F.substring("output_sha256", 1, 1).isin("0", "1", "2", "3")
    steps = c.join(before, ["chain", "step_index"], "left").withColumn(
        "input_sha256", F.when(wrong, F.sha2("output_sha256", 256)).otherwise(F.col("_o")))
    return integrity.transform_breaks(steps.drop("_o", "role"))


@query("transform_steps", """
select conv_id, turn, case when role = 'assistant' and turn > 2 then 'TRANSFORM_LOSSY_DESCR_MISSING' end as refusal,
 sha256('{"conv_id":' || conv_id || ',"input_sha256":"' || sha256(text) || '","lossiness_description":' ||
  case when role='assistant' and turn > 2 then '""' when role='assistant' then '"shortened"' else 'null' end || ',"lossy":' || (role='assistant')::varchar || ',"turn":' || turn || '}' || chr(10)) as step_sha256 from conversations""")
def transform_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "conversations").select(
        "conv_id", "turn", F.sha2("text", 256).alias("input_sha256"), (F.col("role") == "assistant").alias("lossy"),
        F.when(F.col("turn") > 2, "").otherwise("shortened").alias("lossiness_description"))
    return integrity.transform_steps(steps).select("conv_id", "turn", "refusal", "step_sha256")


@query("packet_parent_chain", """
with p as (select conv_id, turn + 1 as sequence, sha256(text) as h, role from conversations)
select conv_id::varchar as chain, sequence, 'PREVIOUS_HASH' as problem from p where role = 'assistant' and sequence > 3""")
def packet_parent_chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("chain"), (F.col("turn") + 1).alias("sequence"), F.sha2("text", 256).alias("event_sha256"), "role")
    before = p.select("chain", (F.col("sequence") + 1).alias("sequence"), F.col("event_sha256").alias("_b"))
    linked = p.join(before, ["chain", "sequence"], "left").withColumn("previous_event_sha256", F.when(
        F.col("sequence") == 1, integrity.ZERO_HASH).when((F.col("role") == "assistant") & (F.col("sequence") > 3), "none").otherwise(F.col("_b")))
    return integrity.chain_breaks(linked)


_STATES = {"view": "SCOPED", "click": "AUDITED", "purchase": "IMPLEMENTING", "signup": "BLOCKED", "error": "FAILED"}


def run_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Fifty events in a row as the revisions of a run; the mission is the day, so it drifts."""
    e = table(spark, d, "events")
    state = F.create_map(*[F.lit(x) for p in _STATES.items() for x in p])[F.col("event_type")]
    rows = e.select(F.expr("event_id div 50").alias("run_id"), (F.col("event_id") % 50).alias("revision"), state.alias("_state"),
                    F.sha2(F.col("event_id").cast("string"), 256).alias("record_sha256"), F.col("event_id").alias("created_at"),
                    F.date_format("ts", "yyyy-MM-dd").alias("mission"))
    rows = rows.withColumn("state", F.when(F.col("revision") == 0, "DRAFT").otherwise(F.col("_state"))).drop("_state")
    before = rows.select("run_id", (F.col("revision") + 1).alias("revision"), F.col("record_sha256").alias("_p"), F.col("state").alias("_ps"))
    kind = integrity.event_kind(F.col("state"))
    return rows.join(before, ["run_id", "revision"], "left").select(
        "run_id", "revision", F.when(F.col("state") == "FAILED", "lost").otherwise(F.col("_p")).alias("parent_sha256"), "record_sha256",
        "state", F.when(F.col("state") == "AUDITED", "CLOSE").otherwise(kind).alias("event_kind"),
        F.col("_ps").alias("resume_state"), "created_at", "mission")


_ALLOWED = ", ".join(f"'{a}>{b}'" for a, targets in integrity.TRANSITIONS.items() for b in targets)


@query("revision_violations", f"""
with e as (select event_id // 50 as run_id, event_id % 50 as revision, event_id, strftime(ts,'%Y-%m-%d') as mission,
 case event_type when 'view' then 'SCOPED' when 'click' then 'AUDITED' when 'purchase' then 'IMPLEMENTING' when 'signup' then 'BLOCKED' else 'FAILED' end as st from events),
s as (select *, case when revision = 0 then 'DRAFT' else st end as state from e),
p as (select *, lag(state) over w as ps, lag(mission) over w as pm, lag(lag_state) over w as pps from (select *, lag(state) over (partition by run_id order by revision) as lag_state from s) window w as (partition by run_id order by revision))
select run_id, revision::bigint as revision, violation from (
 select run_id, revision, 'PARENT_HASH' as violation from p where revision > 0 and state = 'FAILED'
 union all select run_id, revision, 'TRANSITION_REFUSED' from p where revision > 0 and (ps || '>' || state) not in ({_ALLOWED})
 union all select run_id, revision, 'RESUME_STATE' from p where revision > 0 and ps = 'BLOCKED' and state not in ('FAILED','STALE','SUPERSEDED','ABORTED') and state is distinct from pps
 union all select run_id, revision, 'EVENT_KIND' from p where revision > 0 and state = 'AUDITED'
 union all select run_id, revision, 'FROZEN_MISSION' from p where revision > 0 and mission <> pm)""")
def revision_violations(spark: SparkSession, d: str) -> DataFrame:
    return integrity.revision_violations(run_revisions(spark, d), ["mission"])


@query("state_tables", f"""
with s as (select distinct case event_type when 'view' then 'SCOPED' when 'click' then 'AUDITED' when 'purchase' then 'IMPLEMENTING' when 'signup' then 'BLOCKED' else 'FAILED' end as state from events)
select a.state as from_state, b.state as to_state, (a.state || '>' || b.state) in ({_ALLOWED}) as allowed,
 case b.state when 'BLOCKED' then 'BLOCKED' when 'FAILED' then 'FAILED' else 'OPEN' end as outcome from s a, s b""")
def state_tables(spark: SparkSession, d: str) -> DataFrame:
    state = F.create_map(*[F.lit(x) for p in _STATES.items() for x in p])[F.col("event_type")]
    seen = table(spark, d, "events").select(state.alias("s")).distinct()
    pairs = seen.select(F.col("s").alias("from_state"), F.explode(F.array(*[F.lit(s) for s in _STATES.values()])).alias("to_state"))
    return pairs.join(seen.select(F.col("s").alias("to_state")), "to_state", "left_semi").select(
        "from_state", "to_state", integrity.transition_allowed(F.col("from_state"), F.col("to_state")).alias("allowed"),
        integrity.state_outcome(F.col("to_state")).alias("outcome"))


# ---- graphs -----------------------------------------------------------------------------


def part_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers depend on their nation's first supplier; that one depends on the region;
    nation 3 depends on its own suppliers, which makes cycles; region 4 does not exist."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    sup = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    nat = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    edges = s.select(sup.alias("id"), nat.alias("depends_on"))
    edges = edges.unionByName(s.filter("s_nationkey = 3").select(nat.alias("id"), sup.alias("depends_on")))
    edges = edges.unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                                       F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("depends_on")))
    edges = edges.unionByName(s.filter("s_acctbal < 0").select(sup.alias("id"), sup.alias("depends_on")))
    nodes = s.select(sup.alias("id")).unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")))
    nodes = nodes.unionByName(table(spark, d, "region").filter("r_name <> 'EUROPE'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")))
    return nodes, edges


@query("dependency_problems", """
select 's' || s_suppkey as id, 'n3' as depends_on, 'CYCLE_DEPENDENCY' as problem from supplier where s_nationkey = 3
union all select 'n3', 's' || s_suppkey, 'CYCLE_DEPENDENCY' from supplier where s_nationkey = 3
union all select 's' || s_suppkey, 's' || s_suppkey, 'SELF_DEPENDENCY' from supplier where s_acctbal < 0
union all select 'n' || n_nationkey, 'r' || n_regionkey, 'UNKNOWN_DEPENDENCY' from nation join region on r_regionkey = n_regionkey where r_name = 'EUROPE'""")
def dependency_problems(spark: SparkSession, d: str) -> DataFrame:
    return integrity.dependency_problems(*part_graph(spark, d))


@query("lineage_depths", """
with recursive e as (select event_id as id, event_id - user_id - 1 as parent_id from events where event_id - user_id - 1 >= 0),
w as (select id, parent_id as root_id, 1 as depth from e union all select w.id, e.parent_id, w.depth + 1 from w join e on e.id = w.root_id)
select id, min(root_id) as root_id, max(depth)::bigint as depth from w group by id""")
def lineage_depths(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") - F.col("user_id") - 1).alias("parent_id")).filter("parent_id >= 0")
    return integrity.lineage_depths(edges, 1 << 20).select("id", "root_id", "depth")


@query("version_ancestors", """
with recursive e as (select event_id as id, event_id // 2 as parent_id from events where event_id > 0 union select event_id, event_id // 3 from events where event_id > 0),
w as (select parent_id as a, 1 as depth from e where id = (select max(event_id) from events) union select e.parent_id, w.depth + 1 from w join e on e.id = w.a)
select a as ancestor_id, min(depth)::bigint as depth from w group by a""")
def version_ancestors(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    parents = F.explode(F.array_distinct(F.array(F.expr("event_id div 2"), F.expr("event_id div 3"))))
    edges = events.filter("event_id > 0").select(F.col("event_id").alias("id"), parents.alias("parent_id"))
    last = events.agg(F.max("event_id").alias("id"))
    return integrity.ancestors(edges, last).select("ancestor_id", F.col("depth").cast("long").alias("depth"))


def lineitem_evidence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("artifact_path"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_locator"),
        (F.col("l_returnflag") != "R").alias("primary"), F.col("l_orderkey").alias("claim_id"))


_EV = """ev as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id, 'p' || l_partkey as a, 's' || l_suppkey as l, l_returnflag <> 'R' as prim, l_orderkey as claim_id from lineitem)"""


@query("shared_lineage", f"""with {_EV}
select 'shared_artifact' as relationship, a as shared_value, min(id) as anchor_id, count(*)::bigint as members, (count(*)*(count(*)-1)//2)::bigint as pair_count from ev group by a having count(*) > 1
union all select 'duplicate_locator', a || '#' || l, min(id), count(*), count(*)*(count(*)-1)//2 from ev group by a, l having count(*) > 1""")
def shared_lineage(spark: SparkSession, d: str) -> DataFrame:
    return integrity.shared_lineage_groups(lineitem_evidence(spark, d))


@query("independence_summary", f"""with {_EV},
p as (select sum(n*(n-1)//2) as s from (select count(*) as n from ev group by a union all select count(*) from ev group by a, l))
select (select count(distinct a) from ev)::bigint as independent_cluster_count, coalesce(s,0)::bigint as shared_pair_count,
 case when s > 0 then 'repeated_report' else 'independent_replication' end as corroboration_type from p""")
def independence_summary(spark: SparkSession, d: str) -> DataFrame:
    return integrity.independence_summary(lineitem_evidence(spark, d))


@query("lineage_edges", f"""with {_EV},
g as (select 'shared_artifact' as relationship, a as shared_value, min(id) as anchor from ev group by a having count(*)>1
 union all select 'duplicate_locator', a || '#' || l, min(id) from ev group by a, l having count(*)>1)
select anchor as source, id as target, relationship, shared_value from g join ev on (relationship='shared_artifact' and a = shared_value) where id <> anchor
union all select anchor, id, relationship, shared_value from g join ev on (relationship='duplicate_locator' and a || '#' || l = shared_value) where id <> anchor""")
def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    return integrity.lineage_edges(lineitem_evidence(spark, d))


def order_traces(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    claims = orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("statement"))
    records = orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("claim_id"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("records_sha256"))
    steps = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("step_index"), F.col("l_linestatus").alias("step_name"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("output_sha256"))
    return evidence.claim_traces(claims, lineitem_evidence(spark, d), steps, records, tasks_for(table(spark, d, "lineitem").select("l_orderkey")))


@query("claim_traces", f"""with {_EV}
select o_orderkey as claim_id, 1 as level_order, 'claim' as level, o_orderkey::varchar as item, o_orderpriority as detail from orders
union all select claim_id, 2, 'result', id, a || '#' || l from ev
union all select o_orderkey, 3, 'record', 'records', case when o_orderstatus <> 'P' then sha256(o_custkey::varchar) else '' end from orders
union all select l_orderkey, 4, 'transformation', l_linenumber::varchar, l_linestatus || '#' || sha256(l_partkey::varchar) from lineitem where l_returnflag='A'
union all select o_orderkey, 4, 'transformation', '0', 'identity_sort' from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag='A')
union all select o_orderkey, 5, 'acquisition', 'acquisition', case when o_orderstatus <> 'P' then 'data_readiness_pass' else 'unverified' end from orders""")
def claim_traces(spark: SparkSession, d: str) -> DataFrame:
    return order_traces(spark, d)


@query("trace_summary", """
with e as (select l_orderkey as k, count(*) as n, count_if(l_returnflag='A') as t from lineitem group by 1)
select o_orderkey as claim_id, (3 + coalesce(n,0) + case when coalesce(t,0) = 0 then 1 else t end)::bigint as level_rows, o_orderstatus <> 'P' and coalesce(n,0) > 0 as complete_to_source
from orders left join e on k = o_orderkey""")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = 2 * table(spark, d, "lineitem").count() + 4 * table(spark, d, "orders").count()  # no claim and no line has more levels
    return evidence.trace_summary(order_traces(spark, d), tasks_for(table(spark, d, "orders"), rows))
