"""Queries that write the given tables as files and read them back through the strict readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.readiness import REQUIRED_CHECKS
from plumbline.plans.registry import query, table
from plumbline.session import checkpoint_dir, freeze, spread
from plumbline.sources import readers, receipts
from plumbline.sources.exports import put_if_absent
from plumbline.sources.versions import VersionStore


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _by_name(scanned: readers.Table) -> DataFrame:
    return scanned.frame.select("ordinal", *(F.col(i).alias(n) for i, n in zip(scanned.ids, scanned.names, strict=True)))


@query("delimited_roundtrip_documents", "select doc_id::varchar as doc_id, lang, source, sha256(text) as text_sha256, n_chars::varchar as n_chars from documents")
def delimited_roundtrip_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with their quotes and line breaks as CSV files, read back in byte ranges."""
    path = _folder(spark, "delimited")
    table(spark, d, "documents").write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    return _by_name(readers.read_delimited(spark, f"{path}/part-*")).select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_chars")


@query("json_roundtrip_events", "select event_id, user_id, event_type, value, props from events")
def json_roundtrip_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an object of JSON arrays (one array a file, every object on its own line), read back in byte ranges."""
    path = _folder(spark, "arrays")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    part = F.pmod(F.xxhash64("event_id"), F.lit(8)).cast("int")
    lines = events.select(part.alias("part"), F.col("event_id").alias("place"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    # The first object of a file opens its array, every other one follows a comma, and the last one is followed by a line that closes it. The bracket
    # belongs to the row of the last object: rows of its own, from another branch of the plan, can be written to another file.
    in_part = Window.partitionBy("part").orderBy("place")
    opening = F.when(F.row_number().over(in_part) == 1, "[").otherwise(",")
    closing = F.when(F.lead("place").over(in_part).isNull(), "\n]").otherwise("")
    lines = lines.withColumn("value", F.concat(opening, "value", closing))
    lines.sortWithinPartitions("part", "place").select("part", "value").write.partitionBy("part").text(path)
    back = _by_name(readers.read_json(spark, f"{path}/part=*"))
    typed = {"event_id": "long", "user_id": "long", "event_type": "string", "value": "double", "props": "string"}
    return back.select(*(F.try_variant_get(name, "$", kind).alias(name) for name, kind in typed.items()))


def customer_rows(spark: SparkSession, d: str) -> DataFrame:
    """The customers as records to be published, in as many parts as there are cores: hashing, checks and digests then work on all of them."""
    return spread(table(spark, d, "customer")).withColumn("ordinal", F.col("c_custkey"))


_CHECKS = ", ".join(f"({n}, '{check}')" for n, check in enumerate(REQUIRED_CHECKS))


@query("readiness_checks_published", f"""
with c(position, check_id) as (values {_CHECKS}), k(version) as (values ('sound'), ('tampered'), ('other plan'), ('latin')),
f as (select count(*) as n, count_if(c_mktsegment = 'BUILDING') as changed from customer)
select version, position, check_id,
 case when version = 'tampered' and check_id in ('source_identity', 'independent_verification') and changed > 0 then 'FAIL'
  when version = 'other plan' and check_id = 'analysis_plan_binding' then 'FAIL' when version = 'latin' and check_id = 'encoding' and changed > 0 then 'FAIL'
  when check_id in ('order_invariance', 'row_reconciliation') and n = 0 then 'FAIL' else 'PASS' end as status
from c, k, f""")
def readiness_checks_published(spark: SparkSession, d: str) -> DataFrame:
    """The gate over four published versions of customer: a sound one, one changed after it was published, one whose plan file
    changed after it was declared, and one with text that is not UTF-8. Every one of the 22 checks is measured."""
    store = VersionStore(spark, _folder(spark, "store"))
    plan, other = f"{store.root}/plans/plan.md", f"{store.root}/plans/other.md"
    put_if_absent(spark, plan, "compare the groups\n")
    put_if_absent(spark, other, "compare the groups\n")
    rows = customer_rows(spark, d)
    building = F.col("c_mktsegment") == "BUILDING"
    latin = rows.withColumn("c_name", F.when(building, F.concat("c_name", F.unhex(F.lit("E9")).cast("string"))).otherwise(F.col("c_name")))
    keyed = {"keys": ["c_custkey"]}
    specs = {
        "sound": receipts.declare(store, store.publish(rows, "CSV", ["sound"]), plan=plan, **keyed),
        "tampered": receipts.declare(store, store.publish(rows, "CSV", ["tampered"]), **keyed),
        "other plan": receipts.declare(store, store.publish(rows, "CSV", ["other plan"]), plan=other, **keyed),
        "latin": receipts.declare(store, store.publish(latin, "CSV", ["latin"]), **keyed),
    }
    path = store.manifest(specs["tampered"].snapshot_id)["records_path"]
    freeze(spark.read.parquet(path).withColumn("c_acctbal", F.when(building, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))).write.mode("overwrite").parquet(path)
    spark.createDataFrame([("compare other groups",)], "t string").write.mode("overwrite").text(other)
    out = None
    for version, spec in specs.items():
        part = receipts.published_checks(store, spec).select(F.lit(version).alias("version"), "position", "check_id", "status")
        out = part if out is None else out.unionByName(part)
    return out
