"""Strict scans of delimited, JSON and text files.

Nothing is coerced: delimited fields and text lines stay strings and JSON fields stay
VARIANT. Malformed input is refused with a code; every check is a distributed filter.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import Refusal
from plumbline.functions.canon import json_text, quoted_key
from plumbline.sources.splitting import Delimited, JsonArray, split_records

MAX_NUMBER_CHARACTERS = 4096


@dataclass(frozen=True)
class Budget:
    """Declared limits; over a limit the source is refused, never cut."""

    max_bytes: int = 512 << 30
    max_records: int = 1 << 50
    max_columns: int = 10_000
    max_field_bytes: int = 1 << 20
    max_depth: int = 64


@dataclass(frozen=True)
class Table:
    """A scanned table: rows keyed by column id plus ordinal, and its column specs."""

    frame: DataFrame
    columns: tuple[tuple[str, str, int, bool], ...]  # column_id, name, position, duplicate_name
    format: str
    header_decision: str

    @property
    def names(self) -> list[str]:
        return [c[1] for c in self.columns]

    @property
    def ids(self) -> list[str]:
        return [c[0] for c in self.columns]

    def content(self) -> DataFrame:
        return self.frame.select(*self.ids)

    def specs(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(
            list(self.columns), "column_id string, name string, position int, duplicate_name boolean")


def column_id(name: str, occurrence: int) -> str:
    text = '{"name":' + quoted_key(name) + ',"occurrence":' + str(occurrence) + "}\n"
    return "col-" + hashlib.sha256(text.encode()).hexdigest()[:16]


def column_specs(names: list[str]) -> tuple[tuple[str, str, int, bool], ...]:
    total, seen, out = Counter(names), Counter(), []
    for place, name in enumerate(names):
        seen[name] += 1
        out.append((column_id(name, seen[name]), name, place, total[name] > 1))
    return tuple(out)


def column_specs_frame(headers: DataFrame, table: str = "table", name: str = "name", position: str = "position") -> DataFrame:
    """Column ids for many headers at once (one row per header cell)."""
    # a header is bounded by the column limit, so a window per (table, name) is small
    seen = F.expr(f"row_number() over (partition by `{table}`, `{name}` order by `{position}`)")
    copies = F.expr(f"count(*) over (partition by `{table}`, `{name}`)")
    body = F.concat(F.lit('{"name":'), json_text(F.col(name)), F.lit(',"occurrence":'), F.col("_seen").cast("string"), F.lit("}\n"))
    return headers.withColumns({"_seen": seen, "_copies": copies}).select(
        F.concat(F.lit("col-"), F.substring(F.sha2(body, 256), 1, 16)).alias("column_id"), table, name, position,
        (F.col("_copies") > 1).alias("duplicate_name"))


def check_header(names: list[str], budget: Budget) -> None:
    if not names:
        raise Refusal("DATA_NO_HEADER", "the table has no header")
    if len(names) > budget.max_columns:
        raise Refusal("DATA_COLUMN_BUDGET", f"{len(names)} columns")
    if any(n.strip() == "" for n in names):
        raise Refusal("DATA_EMPTY_HEADER", "a column has no name")


def source_facts(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, is_utf8) of whole files, hashed on the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"),
                        F.is_valid_utf8(F.col("content").cast("string")).alias("is_utf8"))


def _refuse_encoding(lines: DataFrame) -> None:
    if not lines.filter(~F.is_valid_utf8("value")).limit(1).isEmpty():
        raise Refusal("DATA_ENCODING", "the source is not valid UTF-8")


def with_ordinals(frame: DataFrame, header: bool = False) -> DataFrame:
    """Dense 0-based source positions over all files, in (file, offset) order.

    Rows of one split are read in order, so a row's place is the rows of all earlier splits
    plus its place in its own split. Only one row per split is summed globally. With
    ``header`` the first record of every file is left out.
    """
    tagged = frame.select("*", F.col("_metadata.file_path").alias("_file"),
                          F.col("_metadata.file_block_start").alias("_start")).withColumn(
        "_mid", F.monotonically_increasing_id())
    skip = F.when(F.col("_start") == 0, 1).otherwise(0) if header else F.lit(0)
    splits = tagged.groupBy("_file", "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.expr("sum(_n - _skip) over (order by _file, _start rows between unbounded preceding and current row)")
    offsets = splits.withColumn("_skip", skip).withColumn("_before", before - (F.col("_n") - F.col("_skip")))
    joined = tagged.join(offsets, ["_file", "_start"])
    inside = F.col("_mid") - F.col("_first") - F.col("_skip")
    return joined.filter(inside >= 0).withColumn("ordinal", F.col("_before") + inside).drop(
        "_file", "_start", "_mid", "_first", "_n", "_skip", "_before")


def first_line(spark: SparkSession, path: str) -> str:
    """The first line that is not blank, however many blank ones stand before it."""
    row = spark.read.text(path).filter(F.col("value").rlike(r"\S")).first()
    return row[0] if row else ""


def refuse_spoof(line: str) -> None:
    if line.lstrip("﻿ \t")[:1] in ("{", "["):
        raise Refusal("DATA_FORMAT_SPOOFED", "JSON content under a delimited name")


def read_delimited(spark: SparkSession, path: str, format: str = "CSV", budget: Budget = Budget()) -> Table:
    """Strict CSV or TSV, read in byte ranges however quoted line breaks lie across them (``splitting``).

    Cells are those of the standard strict parser on the same bytes. Every file of a table must begin with the
    same header; a row of another width is refused; blank lines outside quotes are no records.
    """
    refuse_spoof(first_line(spark, path))
    records = split_records(spark, path, Delimited("\t" if format == "TSV" else ","))
    _refuse_kinds(records)
    heads = records.filter("in_file = 0").select("file", "cells")
    first = heads.orderBy("file").first()
    names = list(first["cells"]) if first else []
    refuse_spoof(names[0] if names else "")
    check_header(names, budget)
    other = heads.filter(~F.col("cells").eqNullSafe(F.array(*map(F.lit, names)))).select("file").first()
    if other:
        raise Refusal("DATA_HEADER_MISMATCH", f"{other[0]} begins with another header")
    wrong = records.filter(F.size("cells") != len(names)).select(F.size("cells").alias("n")).first()
    if wrong:
        raise Refusal("DATA_ROW_WIDTH_MISMATCH", "a row does not fit the header", expected_fields=len(names), actual_fields=wrong["n"])
    specs = column_specs(names)
    ids = [s[0] for s in specs]
    cells = [F.col("cells")[n].alias(i) for n, i in enumerate(ids)]
    body = _over_files(records, skip=1).select(*cells, "ordinal")
    check_fields(body, ids, budget)
    decision = "EXPLICIT_DUPLICATE_PRESERVED" if any(s[3] for s in specs) else "EXPLICIT_UNIQUE"
    return Table(body, specs, format, decision)


def _refuse_kinds(records: DataFrame) -> None:
    # The encoding comes first: other bytes may look malformed because of it.
    wrong = records.filter("kind <> 'record'").orderBy(F.col("kind") != "DATA_ENCODING", "file", "in_file").select("kind", "file").first()
    if wrong:
        raise Refusal(wrong["kind"], f"{wrong['file']} was refused")


def _over_files(records: DataFrame, skip: int = 0) -> DataFrame:
    """Records with their place over all files by name, the first ``skip`` of each file left out."""
    sizes = records.groupBy("file").agg((F.count(F.lit(1)) - skip).alias("n"))
    before = sizes.select("file", (F.expr("sum(n) over (order by file)") - F.col("n")).alias("before"))  # one row per file
    placed = records.filter(F.col("in_file") >= skip).join(F.broadcast(before), "file")
    return placed.withColumn("ordinal", F.col("before") + F.col("in_file") - skip)


def check_fields(frame: DataFrame, columns: list[str], budget: Budget) -> None:
    """Field bytes and record count in one aggregate."""
    longest = F.greatest(*[F.max(F.octet_length(F.col(c))) for c in columns], F.lit(0))
    row = frame.agg(F.count(F.lit(1)).alias("n"), longest.alias("longest")).first()
    if row["n"] > budget.max_records:
        raise Refusal("DATA_RECORD_BUDGET", f"{row['n']} records")
    if (row["longest"] or 0) > budget.max_field_bytes:
        raise Refusal("DATA_FIELD_BUDGET", f"{row['longest']} bytes in a field")


def budget_violations(frame: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(limit, observed, allowed) rows for every exceeded limit, from one aggregate."""
    text = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    longest = F.greatest(*[F.coalesce(F.max(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in text], F.lit(0))
    total = sum((F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`")).cast("long")), F.lit(0)) for c in text), F.lit(0))
    facts = frame.agg(F.count(F.lit(1)).alias("max_records"), longest.cast("long").alias("max_field_bytes"),
                      total.alias("max_bytes")).withColumn("max_columns", F.lit(len(frame.columns)).cast("long"))
    rows = [F.when(F.col(k) > v, F.struct(F.lit(k).alias("budget"), F.col(k).alias("observed"),
                                          F.lit(v).cast("long").alias("allowed"))) for k, v in sorted(limits.items())]
    return facts.select(F.explode(F.array_compact(F.array(*rows))).alias("v")).select("v.*")


#: A JSON string. Possessive groups run as a loop; an alternation under a star recurses once per character.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def nesting_depth(text: Column) -> Column:
    """Deepest bracket nesting of a JSON text, strings set aside."""
    bare = F.regexp_replace(F.regexp_replace(text, JSON_STRING, ""), r"[^\[\]{}]++", "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest"))
    return F.aggregate(
        steps, start,
        lambda acc, s: F.struct((acc["now"] + s).alias("now"), F.greatest(acc["deepest"], acc["now"] + s).alias("deepest")),
        lambda acc: acc["deepest"])


NUMBER_TOKEN = r"(?<![\w.+-])-?[0-9][0-9.eE+-]*"


def json_problem(text: Column, budget: Budget) -> Column:
    """First refusal code of a JSON text, NULL when it is acceptable."""
    bare = F.regexp_replace(text, JSON_STRING, '""')
    limit = min(budget.max_field_bytes, MAX_NUMBER_CHARACTERS)
    long_number = F.exists(F.regexp_extract_all(bare, F.lit(NUMBER_TOKEN), F.lit(0)), lambda t: F.length(t) > limit)
    strings = F.regexp_extract_all(text, F.lit(JSON_STRING), F.lit(0))
    long_text = F.exists(strings, lambda t: F.octet_length(t) - 2 > budget.max_field_bytes)
    constant = bare.rlike(r"(?<![\p{L}])(?:NaN|-?Infinity)(?![\p{L}])")
    return (
        F.when(constant, "DATA_JSON_CONSTANT_REFUSED")
        .when(long_number, "DATA_NUMERIC_TOKEN_BUDGET")
        .when(nesting_depth(text) > budget.max_depth, "DATA_NESTING_BUDGET")
        .when(F.try_parse_json(text).isNull() & _duplicate_key(text), "DATA_DUPLICATE_JSON_KEY")
        .when(F.try_parse_json(text).isNull(), "DATA_PARSE_ERROR")
        .when(long_text, "DATA_FIELD_BUDGET")
    )


def _duplicate_key(text: Column) -> Column:
    """A text that only fails to parse because a key repeats still parses leniently."""
    return F.coalesce(F.json_object_keys(text), F.json_object_keys(F.get_json_object(text, "$[0]"))).isNotNull()


def _objects(values: DataFrame, format: str, budget: Budget, order: str) -> Table:
    """VARIANT objects -> columns by the sorted union of their keys, absent kept apart from null."""
    keys = values.select(F.explode(F.json_object_keys(F.to_json("v"))).alias("k")).distinct()
    names = sorted(r[0] for r in keys.limit(budget.max_columns + 1).collect())  # bounded by the column limit
    if not names:
        raise Refusal("DATA_JSON_EMPTY_SCHEMA", "no records or no named fields")
    check_header(names, budget)
    specs = column_specs(names)
    present = F.json_object_keys(F.to_json("v"))
    both = [name for name in names if "'" in name and '"' in name]
    if both:  # a path quotes a key with one of the two
        raise Refusal("DATA_JSON_KEY_UNSUPPORTED", both[0])
    quote = lambda name: f"$['{name}']" if "'" not in name else f'$["{name}"]'
    columns = [F.try_variant_get("v", quote(name), "variant").alias(cid) for cid, name, _, _ in specs]
    frame = values.select(*columns, present.alias("present_keys"), F.col(order).alias("ordinal"))
    return Table(frame, specs, format, "OBJECT_KEYS")


def read_json_lines(spark: SparkSession, path: str, budget: Budget = Budget()) -> Table:
    lines = with_ordinals(spark.read.text(path))
    _refuse_encoding(lines)
    filled = lines.filter(F.trim("value") != "")
    problem = json_problem(F.col("value"), budget)
    bad = filled.select(problem.alias("p")).filter("p is not null")
    first = bad.first()
    if first:
        raise Refusal(first["p"], "a JSON line was refused")
    values = filled.select(F.try_parse_json("value").alias("v"), "ordinal")
    shape = values.filter(~F.schema_of_variant("v").startswith("OBJECT"))
    if not shape.limit(1).isEmpty():
        raise Refusal("DATA_JSONL_SHAPE", "every line must be one object")
    return _objects(values, "JSONL", budget, "ordinal")


def read_json(spark: SparkSession, path: str, budget: Budget = Budget()) -> Table:
    """JSON documents, an object or an array of objects per file; arrays are read in byte ranges (``splitting``)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    starts = lines.filter(F.regexp_replace("value", "^\ufeff", "").rlike(r"[^ \t\r\n]")).groupBy("file").agg(F.min_by(F.substring(F.ltrim(F.regexp_replace("value", "^\ufeff", "")), 1, 1), "at").alias("c"))
    if starts.filter("c <> '['").isEmpty() and not starts.isEmpty():
        return _read_json_arrays(spark, path, budget)
    whole = spark.read.text(path, wholetext=True)
    _refuse_encoding(whole)
    first = whole.select(json_problem(F.col("value"), budget).alias("p")).filter("p is not null").first()
    if first:
        raise Refusal(first["p"], "the JSON document was refused")
    parsed = whole.select(F.try_parse_json("value").alias("d")).withColumn("shape", F.schema_of_variant("d"))
    if not parsed.filter(~F.col("shape").rlike("^(OBJECT|ARRAY)")).limit(1).isEmpty():
        raise Refusal("DATA_JSON_SHAPE", "one object or an array of objects is required")
    single = parsed.filter("shape like 'OBJECT%'").select(F.lit(0).cast("long").alias("ordinal"), F.col("d").alias("v"))
    many = spark.sql(
        "select cast(pos as bigint) as ordinal, value as v from {docs}, lateral variant_explode(d) where shape like 'ARRAY%'",
        docs=parsed)
    values = single.unionByName(many)
    if not values.filter(~F.schema_of_variant("v").startswith("OBJECT")).limit(1).isEmpty():
        raise Refusal("DATA_JSON_SHAPE", "an array holds something other than objects")
    return _objects(values, "JSON", budget, "ordinal")


def _read_json_arrays(spark: SparkSession, path: str, budget: Budget) -> Table:
    records = split_records(spark, path, JsonArray())
    inner = dataclasses.replace(budget, max_depth=budget.max_depth - 1)  # an object stands one level inside its array
    first = records.filter("kind = 'record'").select(json_problem(F.col("text"), inner).alias("p")).filter("p is not null").first()
    if first:
        raise Refusal(first["p"], "the JSON document was refused")
    _refuse_kinds(records)
    values = _over_files(records).select(F.try_parse_json("text").alias("v"), "ordinal")
    return _objects(values, "JSON", budget, "ordinal")


def read_text(spark: SparkSession, path: str, format: str = "UTF8_TEXT", budget: Budget = Budget()) -> Table:
    """One record per physical line in the column ``text``."""
    specs = column_specs(["text"])
    lines = with_ordinals(spark.read.text(path))
    _refuse_encoding(lines)
    frame = lines.select(F.col("value").alias(specs[0][0]), "ordinal")
    check_fields(frame, [specs[0][0]], budget)
    return Table(frame, specs, format, "SYNTHETIC_TEXT_COLUMN")


READERS = {
    "CSV": lambda s, p, b: read_delimited(s, p, "CSV", b),
    "TSV": lambda s, p, b: read_delimited(s, p, "TSV", b),
    "JSON": read_json,
    "JSONL": read_json_lines,
    "UTF8_TEXT": lambda s, p, b: read_text(s, p, "UTF8_TEXT", b),
    "MARKDOWN": lambda s, p, b: read_text(s, p, "MARKDOWN", b),
}
# Suffix to format.
FORMATS = {".csv": "CSV", ".tsv": "TSV", ".json": "JSON", ".jsonl": "JSONL", ".txt": "UTF8_TEXT", ".md": "MARKDOWN"}


def read_source(spark: SparkSession, path: str, format: str | None = None, budget: Budget = Budget()) -> Table:
    """Dispatch on the declared format, else on the suffix."""
    chosen = format or FORMATS.get("." + path.rsplit(".", 1)[-1].lower(), "")
    if chosen not in READERS:
        raise Refusal("DATA_FORMAT_UNSUPPORTED", path)
    return READERS[chosen](spark, path, budget)


def file_readiness(spark: SparkSession, path: str, keys: list[str], tie_break: tuple[str, ...] = (), budget: Budget = Budget(),
                   **policy) -> DataFrame:
    """The 22 checks on a raw file: columns may be named by header or by column id.

    The file is read twice, apart from each other. The declaration is bound to the digests of the first reading;
    source identity and independent verification pass only if the second one gives the same records in the same order.
    """
    from plumbline.operators import ordering, readiness
    from plumbline.sources.versions import hashed, snapshot_digests

    table = read_source(spark, path, budget=budget)

    def resolve(wanted: str) -> str:
        found = [cid for cid, name, _, _ in table.columns if wanted in (cid, name)]
        if len(found) != 1:
            raise Refusal("READINESS_COLUMN_AMBIGUOUS", f"{wanted} matches {len(found)} columns")
        return found[0]

    frame, again = table.content(), read_source(spark, path, budget=budget)
    count, records, order = snapshot_digests(hashed(table.frame.select(*table.ids, "ordinal")))
    same = again.columns == table.columns and snapshot_digests(hashed(again.frame.select(*again.ids, "ordinal"))) == (count, records, order)
    spec = ordering.make_sort_spec(
        frame, [resolve(k) for k in keys], [resolve(t) for t in tie_break], source_records_sha256=records, source_order_sha256=order, **policy)
    return readiness.readiness_checks(frame, spec, readiness.SourceFacts(verified=same, identity=same))
