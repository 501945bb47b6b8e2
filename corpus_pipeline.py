"""From raw documents to packed training sequences, in five stages over whole texts.

Each stage reads all rows that its predecessor kept. The four filters return the columns of documents; packing returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontamination import without_leaks
from plumbline.llm.line_dedup import drop_boilerplate_lines
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import pack_entries
from plumbline.llm.queries import vocabulary_path
from plumbline.llm.toxicity import held_out, without_toxic
from plumbline.session import Scratch

#: No stage but the lines can be said in SQL over whole tables; tests hold the stages against brute force.
ORACLE_SQL = None


def _as_records(docs: DataFrame, **names: str) -> DataFrame:
    """The documents under record names; other columns get names that clash with nothing."""
    return docs.toDF(*(names.get(c, f"document_{n}") for n, c in enumerate(docs.columns)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the model learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("item_id"), "toxic")
    kept = without_toxic(_as_records(docs, doc_id="item_id", text="source_text"), labels.where(~held_out(F.col("item_id"))))
    return kept.toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; ``n_chars`` follows the text.

    A document of boilerplate alone has nothing left and goes. Documents without text or source stay as they are.
    """
    evidence = _as_records(docs, doc_id="evidence_id", source="source_locator", text="extraction")
    left = drop_boilerplate_lines(evidence).where("n_dropped = 0 or n_dropped < n_lines")
    cleaned = left.drop("n_lines", "n_dropped").toDF(*docs.columns)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; documents without words all stay."""
    found = near_duplicates(docs.select(F.col("doc_id").alias("entry_id"), F.col("text").alias("exact_text")))
    dropped = found.where("not kept").select(F.col("entry_id").alias("doc_id")).distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return without_leaks(_as_records(docs, doc_id="entry_id", text="exact_text"), items).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    entries = docs.select(F.col("doc_id").alias("entry_id"), F.col("text").alias("exact_text"))
    return pack_entries(entries, vocabulary_path()).withColumnsRenamed({"entry_id": "doc_id", "entry_tokens": "doc_tokens"})


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        after = Scratch(spark)
        docs = after.freeze(stage(spark, docs, sf_dir))
        before.close()
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
