"""Site-relative boilerplate lines in evidence extractions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts of the joins between line counts and host totals and between pages and boilerplate lines, so that neither a host with a third
#: of all lines nor a line on all of its pages is one task.
HOST_SALTS = 32


def host_of(locator: Column) -> Column:
    """The lower-case host of a URL, or the locator itself when it is no URL; null stays null."""
    host = F.lower(F.regexp_extract(locator, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host).otherwise(locator)


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(" \t\r"))))


def boilerplate_lines(evidence: DataFrame, *, max_ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """One row (``host``, ``line_md5``, ``pages``, ``host_pages``) per line above the ratio on its host.

    A page is one distinct extraction of a host: identical copies are one page, because copies are no
    evidence that a line belongs to the site's frame. A line is compared without spaces, tabs and carriage
    returns at its ends; blank lines do not count. A line is boilerplate when it stands on at least
    ``min_pages`` pages and on more than ``max_ratio`` of the host's pages. Rows without locator or text
    take no part.

    A page sends its distinct line digests once, so no line is counted twice within a page; counts are
    partial sums before the shuffle, and host totals meet them under a salt.
    """
    lines = F.filter(F.split("extraction", "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    pages = (
        evidence.where(F.col("source_locator").isNotNull() & F.col("extraction").isNotNull())
        .select(
            host_of(F.col("source_locator")).alias("host"),
            F.unhex(F.md5("extraction")).alias("page_md5"),
            F.array_distinct(F.transform(lines, _key)).alias("line_md5s"),
        )
        .distinct()
    )
    counts = (
        pages.select("host", F.explode("line_md5s").alias("line_md5"))
        .groupBy("host", "line_md5")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
        .withColumn("salt", F.pmod(F.xxhash64("line_md5"), F.lit(HOST_SALTS)))
    )
    totals = (
        pages.groupBy("host")
        .agg(F.count(F.lit(1)).alias("host_pages"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOST_SALTS - 1).cast("long"))))
    )
    return (
        counts.join(totals, ["host", "salt"])
        .where(F.col("pages") > F.lit(max_ratio) * F.col("host_pages"))
        .select("host", "line_md5", "pages", "host_pages")
    )


def drop_boilerplate_lines(evidence: DataFrame, *, max_ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """Evidence with boilerplate lines removed from ``extraction``; adds ``n_lines`` and ``n_dropped``.

    Needs ``evidence_id``, ``source_locator`` and ``extraction``; every other column is carried through,
    except that ``n_lines`` and ``n_dropped`` are replaced. ``n_lines`` counts the lines that are not blank.
    Kept lines keep their order, spelling and blank lines between them.

    Defined cases: a row with a null locator or null extraction is returned unchanged (0 lines for null);
    an empty extraction stays empty; repeated rows get the same result each; an evidence id that occurs
    with several texts is cleaned in each of them; an empty table gives an empty table. An extraction whose
    every line is boilerplate keeps only its blank lines: without any it becomes empty, with ``n_dropped`` = ``n_lines``.

    Only line digests travel; texts are shuffled at most once, to meet the digests to be dropped.
    """
    carried = [F.col(f"`{c}`") for c in evidence.columns if c not in ("n_lines", "n_dropped")]
    rows = evidence.select(*carried, host_of(F.col("source_locator")).alias("__host"))
    split = F.split("extraction", "\n")
    filled = F.filter(split, lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    digests = F.array_distinct(F.transform(filled, _key))
    bad = boilerplate_lines(evidence, max_ratio=max_ratio, min_pages=min_pages)
    salts = F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))
    salted = bad.select(F.col("host").alias("__host"), "line_md5", F.explode(salts).alias("__salt"))
    hits = (
        rows.select(
            F.col("evidence_id").alias("__id"), "__host", F.pmod(F.xxhash64("evidence_id"), F.lit(HOST_SALTS)).cast("int").alias("__salt"), F.explode(digests).alias("line_md5")
        )
        .join(salted.hint("merge"), ["__host", "line_md5", "__salt"], "left_semi")
        .groupBy("__id", "__host")
        .agg(F.collect_set("line_md5").alias("__bad"))
        .withColumnRenamed("__host", "__hit_host")
    )
    joined = rows.join(hits, F.col("evidence_id").eqNullSafe(F.col("__id")) & F.col("__host").eqNullSafe(F.col("__hit_host")), "left")
    n_lines = F.coalesce(F.size(filled), F.lit(0))
    is_bad = lambda x: (F.btrim(x, F.lit(" \t\r")) != "") & F.array_contains("__bad", _key(x))
    n_bad = F.when(F.col("__bad").isNull(), F.lit(0)).otherwise(F.size(F.filter(split, is_bad)))
    counted = joined.select(*carried, "__bad", n_lines.alias("n_lines"), n_bad.alias("__bad_lines"))
    cleaned = F.when(F.col("__bad_lines") == 0, F.col("extraction")).otherwise(F.array_join(F.filter(split, lambda x: ~is_bad(x)), "\n"))
    return counted.select(
        *[cleaned.alias("extraction") if c == "extraction" else F.col(f"`{c}`") for c in evidence.columns if c not in ("n_lines", "n_dropped")],
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("__bad_lines").cast("long").alias("n_dropped"),
    )
