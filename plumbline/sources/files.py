"""File inventory, preflight and content-addressed intake, hashed on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.operators.digest import multiset_digest
from plumbline.operators.integrity import media_type, suffix_of

# Folders that are never inventoried, sensitive names, sync-folder markers,
# supported suffixes.
IGNORED_FOLDERS = (".git", ".hg", ".svn", ".venv", "venv", "dist", "build", "__pycache__", ".pytest_cache")
SENSITIVE_NAMES = (
    ".env", ".env.*", "credentials*", "secrets*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa*", "id_ed25519*",
    "auth.json", "cookies*", "*.kdbx", "*password*", "*.browser_profile", "client_secret*", "service_account*",
)
SYNC_MARKERS = (
    "onedrive", "icloud", "dropbox", "google drive", "googledrive", "library/mobile documents", "amazon drive",
    "box sync",
)
SUPPORTED_SUFFIXES = (
    ".md", ".txt", ".json", ".jsonl", ".csv", ".tsv", ".py", ".tex", ".bib", ".csl", ".yml", ".yaml", ".toml", ".html",
    ".css", ".js", ".c", ".h", ".cpp", ".rs", ".go", ".java", ".ipynb", ".sql", ".r", ".do", ".log", ".pdf", ".docx",
)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, sha256, size, media_type, is_utf8) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quote(base.replace("file:", "", 1)), "")
    ignored = F.exists(F.split(relative, "/"), lambda part: part.isin(*IGNORED_FOLDERS))
    return files.filter(~ignored).select(
        relative.alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"),
        media_type(relative).alias("media_type"), F.is_valid_utf8(F.col("content").cast("string")).alias("is_utf8"))


def _quote(text: str) -> str:
    return "".join(("\\" + c) if c in r".^$*+?{}[]\|()" else c for c in text)


def tree_digest(manifest: DataFrame) -> DataFrame:
    """One digest over (path, hash) of all files."""
    rows = manifest.select(F.sha2(F.concat_ws("  ", "sha256", "relative_path"), 256).alias("record_sha256"))
    return multiset_digest(rows).select(F.col("row_count").alias("file_count"), F.col("records_sha256").alias("tree_sha256"))


def sensitive(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    hit = F.lit(False)
    for pattern in SENSITIVE_NAMES:
        hit = hit | name.rlike("^" + _quote(pattern).replace(r"\*", ".*") + "$")
    return hit


def preflight(manifest: DataFrame, root: str = "") -> DataFrame:
    """One row of names, sizes and format counts; content is never read."""
    supported = suffix_of(F.col("relative_path")).isin(*SUPPORTED_SUFFIXES)
    markers = [m for m in SYNC_MARKERS if m in root.lower().replace("\\", "/")]
    return manifest.agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("byte_count"),
        F.count_if(supported).alias("supported_files"), F.count_if(~supported).alias("unsupported_files"),
        F.count_if(sensitive(F.col("relative_path"))).alias("sensitive_files"),
    ).withColumn("sync_markers", F.array(*[F.lit(m) for m in markers]).cast("array<string>"))


# ---- intake -----------------------------------------------------------------------------

LEDGER_SCHEMA = "artifact_id string, relative_path string, sha256 string, size long, media_type string, receipt_sha256 string"


def receipt_rows(manifest: DataFrame) -> DataFrame:
    artifact = F.concat(F.lit("raw-"), F.substring("sha256", 1, 16))
    rows = manifest.select(artifact.alias("artifact_id"), "relative_path", "sha256", F.col("size").cast("long").alias("size"),
                           "media_type")
    return rows.withColumn("receipt_sha256", F.sha2(F.concat_ws("\n", *[F.col(c).cast("string") for c in rows.columns]), 256))


def plan_intake(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """(relative_path, sha256, action): NEW content, REPEAT of sealed content, or CHANGED path."""
    sealed = ledger.select("sha256").distinct().withColumn("_sealed", F.lit(True))
    paths = ledger.groupBy("relative_path").agg(F.count(F.lit(1)).alias("_before"))
    joined = manifest.join(sealed, "sha256", "left").join(paths, "relative_path", "left")
    action = F.when(F.col("_sealed").isNotNull(), "REPEAT").when(F.col("_before").isNotNull(), "CHANGED").otherwise("NEW")
    return joined.select("relative_path", "sha256", "size", "media_type", action.alias("action"))


def seal_intake(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Receipts to append: one per new content. Exact repeats add nothing; a recorded path
    with other content is refused."""
    plan = plan_intake(manifest, ledger)
    changed = plan.filter("action = 'CHANGED'").limit(1).collect()
    if changed:
        raise Refusal("IMPORT_SOURCE_CHANGED", changed[0]["relative_path"])
    fresh = plan.filter("action = 'NEW'")
    first = fresh.groupBy("sha256").agg(F.min_by(F.struct("relative_path", "size", "media_type"), "relative_path").alias("f"))
    return receipt_rows(first.select("f.*", "sha256"))


def intake_errors(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    """(artifact_id, problem) rows: receipts that no longer recompute or no longer match bytes."""
    now = manifest.select("relative_path", F.col("sha256").alias("_sha"), F.col("size").alias("_size"))
    body = [c for c in ("artifact_id", "relative_path", "sha256", "size", "media_type")]
    receipt = F.sha2(F.concat_ws("\n", *[F.col(c).cast("string") for c in body]), 256)
    joined = ledger.join(now, "relative_path", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("receipt_sha256") != receipt, "RECEIPT_HASH"),
        F.when(F.col("artifact_id") != F.concat(F.lit("raw-"), F.substring("sha256", 1, 16)), "ARTIFACT_ID"),
        F.when(F.col("_sha").isNull(), "BYTES_MISSING"),
        F.when(F.col("_sha") != F.col("sha256"), "BYTES_CHANGED"),
        F.when(F.col("_size") != F.col("size"), "SIZE_CHANGED")))
    return joined.select("artifact_id", F.explode(problems).alias("problem"))
