"""Registered queries of this subpackage: the given tables mapped to project records and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.chat_format import conversation_digests, located_turns
from plumbline.llm.decontamination import leaked_items
from plumbline.llm.exact_dedup import exact_duplicates
from plumbline.llm.line_dedup import drop_boilerplate_lines
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import pack_entries
from plumbline.llm.repeat_runs import periodic_runs
from plumbline.llm.secret_scan import secret_spans
from plumbline.llm.source_mix import cyclic_weights, mix_sources
from plumbline.llm.token_counts import attribute_tokens, line_sections
from plumbline.llm.token_links import token_links
from plumbline.llm.toxicity import held_out, toxic_spans
from plumbline.llm.warc_records import derived_records, response_records

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary that the queries count and pack with, or another one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(name: str, sql: str | None = None):
    def register(build):
        LLM_QUERIES[name] = build
        if sql:
            LLM_ORACLES[name] = sql
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("entry_id"), F.col("text").alias("exact_text"))


_LINE_SQL = r"""
with page as (select distinct source, text from documents where source is not null and text is not null),
     page_line as (select distinct source, text, trim(l, e' \t\r') as line from (select source, text, unnest(string_split(text, e'\n')) as l from page)),
     counted as (select source, line, count(*) as n from page_line where line <> '' group by all),
     host as (select source, count(*) as total from page group by all),
     bad as (select c.source, c.line from counted c join host h using (source) where c.n >= 2 and c.n > 0.05 * h.total),
     doc as (select doc_id, source, text, string_split(text, e'\n') as ls from documents),
     row_line as (select doc_id, source, text, i, ls[i] as l, trim(ls[i], e' \t\r') as line
                  from (select *, unnest(range(1, len(ls) + 1)) as i from doc)),
     marked as (select r.doc_id, r.source, r.text, r.i, r.l, r.line, b.line is not null as is_bad
                from row_line r left join bad b on r.source = b.source and r.line = b.line),
     folded as (select doc_id, source, text, count(*) filter (line <> '') as n_lines, count(*) filter (is_bad) as n_bad,
                       string_agg(l, e'\n' order by i) filter (not is_bad) as kept
                from marked group by all)
select d.doc_id,
       case when coalesce(f.n_bad, 0) = 0 then d.text else coalesce(f.kept, '') end as text,
       coalesce(f.n_lines, 0)::bigint as n_lines,
       coalesce(f.n_bad, 0)::bigint as n_dropped
from documents d left join folded f
  on d.doc_id is not distinct from f.doc_id and d.source is not distinct from f.source and d.text is not distinct from f.text
"""


@_query("op1_line_dedup", _LINE_SQL)
def op1_line_dedup(spark, d):
    evidence = _table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_locator"), F.col("text").alias("extraction"))
    done = drop_boilerplate_lines(evidence)
    return done.select(F.col("evidence_id").alias("doc_id"), F.col("extraction").alias("text"), "n_lines", "n_dropped")


_NEAR_SQL = r"""
with recursive
word as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingle as (select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as s
            from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from word where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by 1),
pair as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingle x join shingle y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
link as (select a, b from pair join size p on p.doc_id = a join size q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) as component_id,
       d.doc_id = least(d.doc_id, coalesce(r.m, d.doc_id)) as kept
from documents d left join size s using (doc_id) left join (select a as doc_id, min(b) as m from reach group by 1) r using (doc_id)
"""


@_query("op2_minhash_forest", _NEAR_SQL)
def op2_minhash_forest(spark, d):
    return near_duplicates(_entries(_table(spark, d, "documents"))).withColumnRenamed("entry_id", "doc_id")


@_query("op3_secret_entropy")
def op3_secret_entropy(spark, d):
    found = secret_spans(_entries(_table(spark, d, "documents")))
    of_kind = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("entry_id").alias("doc_id"),
        *(F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(joined(of_kind("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@_query("op4_chat_prefixes")
def op4_chat_prefixes(spark, d):
    said = r"\### Assistant: </turn> ok"
    given = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return conversation_digests(located_turns(given.unionByName(probe), local=True))


@_query("op5_warc_derivatives")
def op5_warc_derivatives(spark, d):
    artifacts = _table(spark, d, "pages").select(
        F.col("page_id").alias("artifact_id"),
        F.col("url").alias("logical_label"),
        F.lit("text/html; charset=utf-8").alias("media_type"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at_utc"),
        F.col("html").alias("body"),
    )
    return derived_records(response_records(artifacts)).withColumnRenamed("artifact_id", "page_id")


@_query("op6_toxic_spans")
def op6_toxic_spans(spark, d):
    items = _table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("source_text"))
    labels = _table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), "toxic").where(~held_out(F.col("item_id")))
    done = toxic_spans(items, labels).withColumn("held_out", F.coalesce(held_out(F.col("item_id")), F.lit(False)))
    return done.select(F.col("item_id").alias("doc_id"), "held_out", "score", "predicted", F.size("spans").alias("n_spans"), F.col("spans").cast("string").alias("spans"))


@_query("op7_token_attribution")
def op7_token_attribution(spark, d):
    sectioned = _table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), "text", line_sections(F.col("text")).alias("sections"))
    counted = attribute_tokens(sectioned, vocabulary_path(), rule="largest")
    return counted.select(F.col("evidence_id").alias("doc_id"), F.col("section").cast("int").alias("line"), "start", "end", "n_tokens", "n_crossing")


_EXACT_SQL = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
     g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256 from n join g using (t)
"""


@_query("op8_exact_dedup", _EXACT_SQL)
def op8_exact_dedup(spark, d):
    done = exact_duplicates(_entries(_table(spark, d, "documents")))
    return done.withColumnsRenamed({"entry_id": "doc_id", "exact_text_sha256": "text_sha256"})


@_query("op9_trial_items")
def op9_trial_items(spark, d):
    items = _table(spark, d, "benchmark").select("item_id", "text")
    return leaked_items(_entries(_table(spark, d, "documents")), items).withColumnRenamed("entry_id", "doc_id")


@_query("op10_packing")
def op10_packing(spark, d):
    pieces = pack_entries(_entries(_table(spark, d, "documents")), vocabulary_path())
    return pieces.withColumnsRenamed({"entry_id": "doc_id", "entry_tokens": "doc_tokens"})


def _looped(doc_id: Column, text: Column) -> Column:
    """The contract's planted texts: of every tenth id, by its checksum, the words from one on repeat a stretch of words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def loop(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        copies = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(copies, 1, n - a)), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # As a lambda's argument the words are split once.
    return F.when(h % 10 == 0, F.coalesce(F.transform(F.array(words), loop)[0], text)).otherwise(text)


@_query("op11_periodic_runs")
def op11_periodic_runs(spark, d):
    documents = _table(spark, d, "documents")
    entries = documents.select(F.col("doc_id").alias("entry_id"), _looped(F.col("doc_id"), F.col("text")).alias("exact_text"))
    best = F.col("strongest_run")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return periodic_runs(entries).select(
        F.col("entry_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("strongest_run.length * 1000 div strongest_run.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@_query("op12_token_links")
def op12_token_links(spark, d):
    entries = _entries(_table(spark, d, "documents"))
    return token_links(entries, vocabulary_path(), vocabulary_path("piece_bpe_32k.model")).withColumnRenamed("entry_id", "doc_id")


_MIX_SQL = r"""
with doc as (select row_number() over () as rid, doc_id, case when source is null then '' else 's' || source end as k,
                    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '') || ':mix') as h from documents),
     src as (select k, sum(size)::bigint as source_size, case (row_number() over (order by k = '', k) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from doc group by k),
     budget as (select (sum(source_size) * 150 // 100)::bigint as b from src),
     prefix as (select sum(2 * source_size) over o as caps, sum(weight) over () - sum(weight) over o as rest from src
                window o as (order by 2 * source_size / weight, k rows unbounded preceding)
                union all select 0, sum(weight) from src),
     level as (select max(((select b from budget) - caps)::double / rest::double) as l from prefix where rest > 0),
     aim as (select *, case when 2 * source_size <= l * weight then (2 * source_size)::double else l * weight end as target from src, level),
     queue as (select d.*, a.source_size, a.weight, a.target,
                      sum(size) over (partition by k order by h, doc_id nulls first, size rows unbounded preceding) - size as start from doc d join aim a using (k)),
     copy as (select rid, k, size, weight, unnest([start, source_size + start]) as start from queue where size > 0),
     cut as (select *, unnest(range(0, (size + 255) // 256)) as p from copy),
     serving as (select rid, k, (start + least((p + 1) * 256, size))::bigint as stop, least((p + 1) * 256, size) - p * 256 as words, weight from cut),
     served as (select rid, words, sum(words) over (order by stop::double / weight, k, stop rows unbounded preceding) as total from serving),
     taken as (select rid, sum(greatest(0, least(words, (select b from budget) - (total - words)))) as taken from served group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, ((start + size)::bigint)::double / weight as virtual_finish
from queue left join taken using (rid)
"""


@_query("op13_source_mix", _MIX_SQL)
def op13_source_mix(spark, d):
    evidence = _table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_locator"), F.col("text").alias("extraction"))
    return mix_sources(evidence, cyclic_weights(evidence)).withColumnRenamed("evidence_id", "doc_id")
