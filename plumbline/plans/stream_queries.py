"""Streaming operators driven to completion over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.integrity import ZERO_HASH
from plumbline.plans.registry import query, table
from plumbline.session import checkpoint_dir, tasks_for
from plumbline.streaming import streams


def work_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a stream: a folder of part files, or the one file of that name."""
    source, schema = f"{d}/{name}.parquet", table(spark, d, name).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(source)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("stream_intake", "select sha256(text) as sha256, octet_length(encode(text))::bigint as size from documents group by text")
def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    arrivals = streamed(spark, d, "documents").select(
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    for attempt in ("a", "b"):  # the second run replays everything and must add nothing
        streams.start_intake(arrivals, "sha256", folder + "/ledger", f"{folder}/checkpoint-{attempt}").awaitTermination()
    return spark.read.parquet(folder + "/ledger").select("sha256", "size")


def event_chains(spark: SparkSession, d: str) -> DataFrame:
    """Fifty events in a row as a chain; error events carry a wrong predecessor hash, and signups
    under 5 are lost."""
    rows = table(spark, d, "events").select(
        F.expr("event_id div 50").cast("string").alias("chain"), (F.col("event_id") % 50 + 1).alias("sequence"),
        "event_type", "value", F.sha2(F.col("event_id").cast("string"), 256).alias("event_sha256"))
    before = rows.select("chain", (F.col("sequence") + 1).alias("sequence"), F.col("event_sha256").alias("_b"))
    previous = F.when(F.col("sequence") == 1, ZERO_HASH).when(F.col("event_type") == "error", "lost").otherwise(F.col("_b"))
    key, tasks = ["chain", "sequence"], tasks_for(table(spark, d, "events"))
    return rows.repartition(tasks, *key).join(before.repartition(tasks, *key).hint("merge"), key, "left").filter("not (event_type = 'signup' and value < 5)").select(
        "chain", "sequence", previous.alias("previous_event_sha256"), "event_sha256", F.col("event_type").alias("state"))


_CHAINS = """
with e as (select (event_id // 50)::varchar as chain, event_id % 50 + 1 as sequence, event_type, value from events),
k as (select *, lag(sequence) over (partition by chain order by sequence) as ps from e where not (event_type = 'signup' and value < 5))
select chain, sequence, 'SEQUENCE_GAP' as problem from k where (ps is null and sequence > 1) or ps <> sequence - 1
union all select chain, sequence, 'PREVIOUS_HASH' from k where event_type = 'error' and sequence > 1 and ps = sequence - 1"""


@query("stream_chain_breaks", _CHAINS)
def stream_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark)
    tasks = tasks_for(table(spark, d, "events"))
    event_chains(spark, d).repartition(tasks, "event_sha256").write.parquet(folder + "/events")  # arrives out of order
    return checked_chains(spark, folder)


def checked_chains(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Breaks of the part files in ``folder/events``; when all are read, the same stream goes on with the closing rows."""
    streams.use_rocksdb(spark)
    written = spark.read.parquet(folder + "/events")
    reader = spark.readStream.schema(written.schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    for closed in (False, True):
        if closed:
            streams.closing_rows(written).write.mode("append").parquet(folder + "/events")
        breaks = streams.chain_breaks_stream(reader.parquet(folder + "/events"))
        breaks.writeStream.format("parquet").option("path", folder + "/breaks").option("checkpointLocation", folder + "/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(streams.BREAK_SCHEMA).parquet(folder + "/breaks")


@query("stream_daily_readiness", """
with k as (select date_trunc('day', ts) as w, case when event_type = 'error' then null else user_id end as key, count(*) as n from events group by 1,2)
select strftime(w, '%Y-%m-%d') as day, sum(n)::bigint as row_count, count_if(n > 1 and key is not null)::bigint as duplicate_key_count, coalesce(sum(case when key is null then n end),0)::bigint as null_key_rows
from k group by 1""")
def stream_daily_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Every day, the last one too: counts are upserts, so no day waits for a watermark and no row is late."""
    folder = work_folder(spark)
    events = streamed(spark, d, "events").withColumn("key", F.when(F.col("event_type") != "error", F.col("user_id")))
    counts = streams.daily_key_counts(events, "ts", "key", delay=None)
    streams.start_counts(counts, folder + "/counts", folder + "/checkpoint").awaitTermination()
    return streams.daily_readiness(streams.latest_counts(spark.read.parquet(folder + "/counts"))).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "row_count", "duplicate_key_count", "null_key_rows")
