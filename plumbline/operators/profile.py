"""Column profiles, anomalies, column roles and the sort-plan proposal."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import Refusal
from plumbline.functions.canon import is_missing, json_value, record_hashes
from plumbline.functions.lexical import formula_like, is_iso_datetime, looks_like_hash, value_type

INLINE_BYTES = 64  # longer values are counted by their hash, so a shuffled cell stays small

# Anomaly codes with their class and message.
ANOMALIES = {
    "CASE_COLLISION_HEADERS": ("LEAD", "Column names differ only by case and require user review."),
    "CONFLICTING_USER_ANNOTATIONS_PRESERVED": (
        "CANDIDATE", "Conflicting user-confirmed units or semantic types remain preserved for review."),
    "DUPLICATE_HEADERS_PRESERVED": (
        "LEAD", "Duplicate header names were preserved as distinct positional columns."),
    "EXACT_DUPLICATE_ROWS": ("CANDIDATE", "Exact duplicate records are present and remain preserved."),
    "FORMULA_LIKE_TEXT_PRESERVED": (
        "LEAD",
        "Formula-like text was preserved without execution and requires review before spreadsheet export."),
    "MIXED_LEXICAL_TYPES": (
        "CANDIDATE", "One column contains multiple lexical or structural type candidates."),
    "NO_CANDIDATE_KEY": (
        "LEAD", "No single complete unique column was observed; record identity remains user-declared."),
}


def _token(column: Column, dtype: T.DataType) -> Column:
    text = json_value(column, dtype)
    return F.when(F.octet_length(text) > INLINE_BYTES, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


# Value types as numbers: counters over numbers stay in the hash aggregate.
TYPE_NAMES = ("NULL", "BOOLEAN", "INTEGER", "NUMBER", "DATETIME", "STRING", "OBJECT", "ARRAY")


def _type_code(column: Column, dtype: T.DataType) -> Column:
    names = F.array(*[F.lit(n) for n in TYPE_NAMES])
    return (F.array_position(names, value_type(column, dtype)) - 1).cast("int")


def column_values(frame: DataFrame, place: int) -> DataFrame:
    """Distinct values of one column: (position, present, n, type_code, formula).

    Only this column is read. Values are grouped in their own type, and long text by
    its hash; a value that fills a third of the column is one partial row per task
    before the shuffle. The type of a non-text value follows from its column.
    """
    field = frame.schema.fields[place]
    column, dtype = F.col(f"`{field.name}`"), field.dataType
    missing = is_missing(column, dtype)
    if isinstance(dtype, T.StringType):
        grouped = frame.select(
            F.when(~missing, _token(column, dtype)).alias("v"),
            F.when(missing, 0).otherwise(_type_code(column, dtype)).alias("t"),
            formula_like(column).cast("int").alias("f"),
        ).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("type_code"), F.max("f").alias("formula"))
        present = F.col("v").isNotNull()
    elif isinstance(dtype, (T.VariantType, T.MapType)):
        grouped = frame.select(
            F.when(~missing, _token(column, dtype)).alias("v"),
            F.when(missing, 0).otherwise(_type_code(column, dtype)).alias("t"),
        ).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("type_code"), F.lit(0).alias("formula"))
        present = F.col("v").isNotNull()
    else:
        grouped = frame.select(column.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        present = F.col("v").isNotNull()
        grouped = grouped.withColumns({
            "type_code": F.when(present, _type_code(F.col("v"), dtype)).otherwise(0), "formula": F.lit(0)})
    return grouped.select(F.lit(place).alias("position"), present.alias("present"), "n", "type_code", "formula")


def column_profile(frame: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per column: observed type, missing, distinct and candidate-key facts."""
    values = column_values(frame, 0)
    for place in range(1, len(frame.columns)):
        values = values.unionByName(column_values(frame, place))

    def seen(name: str) -> Column:
        return F.max((F.col("type_code") == TYPE_NAMES.index(name)).cast("int"))

    numeric = seen("INTEGER") + seen("NUMBER")
    other = sum((seen(t) for t in ("BOOLEAN", "DATETIME", "STRING", "OBJECT", "ARRAY")), F.lit(0))
    observed = (
        F.when(numeric + other == 0, "NULL")
        .when(other == 0, F.when(seen("NUMBER") == 1, "NUMBER").otherwise("INTEGER"))
        .when(numeric + other == 1, F.element_at(F.array(*[F.lit(n) for n in TYPE_NAMES]), F.max("type_code") + 1))
        .otherwise("MIXED")
    )
    per = values.groupBy("position").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~F.col("present"), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if("present").alias("distinct_count"),
        observed.alias("observed_type"),
        (F.max("formula") == 1).alias("formula_like"),
    )
    labels = F.array(*[F.lit(n) for n in (names or frame.columns)])
    return per.select(
        "position", F.element_at(labels, F.col("position") + 1).alias("name"), "observed_type", "row_count",
        "null_count", "distinct_count",
        ((F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count"))).alias("candidate_key"),
        "formula_like",
    )


def approximate_profile(frame: DataFrame, rsd: float = 0.02) -> DataFrame:
    """One-pass sketch of the distinct counts, reported as approximate."""
    aggregates = []
    for i, field in enumerate(frame.schema.fields):
        column = F.col(f"`{field.name}`")
        present = F.when(~is_missing(column, field.dataType), column)
        aggregates += [
            F.count_if(is_missing(column, field.dataType)).alias(f"n{i}"),
            F.approx_count_distinct(present, rsd).alias(f"d{i}"),
        ]
    one = frame.agg(*aggregates)
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.col(f"n{i}").alias("null_count"),
                 F.col(f"d{i}").alias("approx_distinct_count"))
        for i, name in enumerate(frame.columns)
    ]
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def exact_duplicates(frame: DataFrame) -> DataFrame:
    """One row: rows that repeat an earlier equal record."""
    counts = record_hashes(frame).groupBy("record_sha256").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_row_count"))


def header_collisions(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names used twice, and case-folded names shared by several columns (the header is small)."""
    repeated = sorted(n for n, k in Counter(names).items() if k > 1)
    folded = sorted(n for n, k in Counter(n.casefold() for n in names).items() if k > 1)
    return repeated, folded


def anomalies(frame: DataFrame, profile: DataFrame | None = None, duplicates: DataFrame | None = None,
              names: Sequence[str] | None = None, annotation_conflict: bool = False) -> DataFrame:
    """Distinct, sorted (classification, code, message) rows."""
    names = list(names or frame.columns)
    profile = profile if profile is not None else column_profile(frame)
    duplicates = duplicates if duplicates is not None else exact_duplicates(frame)
    repeated, folded = header_collisions(names)
    from_columns = profile.agg(
        F.bool_or(F.col("observed_type") == "MIXED").alias("MIXED_LEXICAL_TYPES"),
        F.bool_or("formula_like").alias("FORMULA_LIKE_TEXT_PRESERVED"),
        (~F.bool_or("candidate_key")).alias("NO_CANDIDATE_KEY"),
        F.lit(bool(repeated)).alias("DUPLICATE_HEADERS_PRESERVED"),
        F.lit(bool(folded) and not repeated).alias("CASE_COLLISION_HEADERS"),
        F.lit(annotation_conflict).alias("CONFLICTING_USER_ANNOTATIONS_PRESERVED"),
    )
    from_rows = duplicates.select((F.col("exact_duplicate_row_count") > 0).alias("EXACT_DUPLICATE_ROWS"))

    def raised(one: DataFrame) -> DataFrame:
        rows = [
            F.when(F.col(code), F.struct(F.lit(ANOMALIES[code][0]).alias("classification"), F.lit(code).alias("code"),
                                         F.lit(ANOMALIES[code][1]).alias("message")))
            for code in one.columns
        ]
        return one.select(F.explode(F.array_compact(F.array(*rows))).alias("a")).select("a.*")

    return raised(from_columns).unionByName(raised(from_rows)).distinct().orderBy("classification", "code", "message")


def annotations(spark: SparkSession, columns: Sequence[tuple[str, str]], units=(), semantic_types=()) -> DataFrame:
    """User statements ``COLUMN=VALUE``; each must name exactly one column. Conflicts are kept."""
    rows = set()
    for kind, values in (("UNIT", units), ("SEMANTIC_TYPE", semantic_types)):
        for statement in values:
            selector, mark, value = (part.strip() for part in statement.partition("="))
            if not (mark and selector and value) or len(value) > 256 or not value.isprintable():
                raise Refusal("DATA_ANNOTATION_INVALID", f"{kind} must be COLUMN=VALUE", statement=statement)
            found = [cid for cid, name in columns if selector in (cid, name)]
            if len(found) != 1:
                raise Refusal("DATA_ANNOTATION_COLUMN_INVALID", f"{selector} matches {len(found)} columns")
            rows.add((found[0], kind, value, "USER_CONFIRMED"))
    return spark.createDataFrame(
        sorted(rows), "column_id string, annotation_kind string, value string, confirmation string")


def annotation_conflicts(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("column_id", "annotation_kind").agg(F.count_distinct("value").alias("value_count"))
        .filter("value_count > 1")
    )


# Name tokens of each column role.
ROLE_TOKENS = {
    "timestamp": ("timestamp", "datetime", "date", "time", "ts", "dt", "day", "week", "month", "year"),
    "entity": ("id", "uuid", "entity", "subject", "participant", "respondent", "user", "patient", "unit", "source",
               "device", "phone"),
    "wave": ("wave", "visit", "timepoint", "round", "session", "phase", "period", "t_", "tp"),
    "condition": ("condition", "treatment", "arm", "experiment", "intervention", "exposure"),
    "replicate": ("replicate", "rep", "run", "trial", "iteration", "block", "lane"),
    "measure": ("measure", "metric", "variable", "outcome", "item", "question", "indicator", "score", "response",
                "answer", "instrument", "tool"),
    "sequence": ("seq", "sequence", "order", "event", "position", "section", "step"),
    "version": ("version", "revision", "rev", "v"),
}
TIME_SUFFIXES = ("_at", "_on", "_utc", "_local", "_date", "_time")
RESPONDENT_TOKENS = ("respondent", "user", "participant")


def name_tokens(name: Column) -> Column:
    """Lower-case tokens of a column name, split at separators and before inner capitals."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(spaced), r"[_ \-]+"), lambda t: t != "")


def column_roles(names: DataFrame) -> DataFrame:
    """(name, position) -> one row per (column, role) from its name tokens."""
    tokens = name_tokens(F.col("name"))
    roles = []
    for role, words in ROLE_TOKENS.items():
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
        if role == "timestamp":
            for suffix in TIME_SUFFIXES:
                hit = hit | F.lower("name").endswith(suffix)
        roles.append(F.when(hit, F.lit(role)))
    return names.select("name", "position", F.explode(F.array_compact(F.array(*roles))).alias("role"))


def _as_text(frame: DataFrame, name: str) -> Column:
    field = next(f for f in frame.schema.fields if f.name == name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(F.col(f"`{name}`"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.col(f"`{name}`").cast("string")


def sampled_datetime_ratio(frame: DataFrame, ordinal: str, columns: Sequence[str], sample: int | None = None) -> DataFrame:
    """Share of ISO-parsable values among the non-blank ones, per column: one aggregate over all rows.

    ``sample`` looks at the first rows by ordinal only, for those who ask for it.
    """
    head = frame if sample is None else frame.filter(F.col(ordinal) < sample)
    rows = [F.struct(F.lit(c).alias("name"), F.trim(_as_text(frame, c)).alias("value")) for c in columns]
    flat = head.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    parsed = F.count_if(filled & F.coalesce(is_iso_datetime(F.col("value")), F.lit(False)))
    seen = F.count_if(filled)
    return flat.groupBy("name").agg(
        seen.alias("seen"), parsed.alias("parsed"),
        F.when(seen > 0, parsed / seen).otherwise(F.lit(0.0)).alias("datetime_ratio"),
        (F.coalesce(F.bool_and(F.when(filled, looks_like_hash(F.col("value")))), F.lit(False))).alias("hash_like"),
    )


def sampled_unique_ratio(frame: DataFrame, ordinal: str, keys: Sequence[str], sample: int | None = None) -> DataFrame:
    """Distinct key tuples over rows; ``sample`` looks at the first rows by ordinal only."""
    head = frame if sample is None else frame.filter(F.col(ordinal) < sample)
    tuple_ = F.struct(*[F.coalesce(_as_text(frame, k), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)])
    n = F.count(F.lit(1))
    return head.agg(n.alias("rows"), F.count_distinct(tuple_).alias("distinct_keys")).withColumn(
        "unique_ratio", F.when(F.col("rows") > 0, F.col("distinct_keys") / F.col("rows")).otherwise(F.lit(0.0)))


def classify_columns(frame: DataFrame, ordinal: str) -> DataFrame:
    """(name, position, role): name roles, timestamps confirmed by the sample, hash-like columns."""
    spark = frame.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(frame.columns)], "name string, position int")
    facts = sampled_datetime_ratio(frame, ordinal, frame.columns)
    named = column_roles(names).join(facts, "name").filter("role <> 'timestamp' or datetime_ratio >= 0.5")
    settled = named.filter("role in ('timestamp','entity')").select("name").distinct()
    hashed = names.join(facts.filter("hash_like"), "name").join(settled, "name", "left_anti")
    return named.select("name", "position", "role").unionByName(
        hashed.select("name", "position", F.lit("hash").alias("role")))


def propose_sort_plan(frame: DataFrame, ordinal: str) -> DataFrame:
    """One row with a proposed identity and order. A proposal only: it is never applied.

    Decided from at most (columns x roles) facts, each an aggregate over the whole table.
    """
    spark = frame.sparkSession
    roles: dict[str, list[str]] = {r: [] for r in (*ROLE_TOKENS, "hash")}
    for row in classify_columns(frame, ordinal).orderBy("position").collect():  # header-sized
        roles[row["role"]].append(row["name"])
    first = {r: (v[0] if v else None) for r, v in roles.items()}
    tokens = {c: set(_tokens_of(c)) for c in roles["entity"]}
    respondent = next((c for c in roles["entity"] if tokens[c] & set(RESPONDENT_TOKENS)), None)
    generic = [c for c in roles["entity"] if c in ("id", "uuid")]
    kind, keys, ties = None, [], []
    if first["timestamp"]:
        kind, keys = "time_series", [c for c in (first["entity"], first["timestamp"]) if c]
        ties = [first["sequence"]]
    elif respondent and first["wave"]:
        kind, keys, ties = "survey", [respondent, first["wave"]], [first["measure"]]
    elif first["entity"] and first["wave"]:
        kind, keys, ties = "panel_longitudinal", [first["entity"], first["wave"]], [first["measure"]]
    elif first["entity"] and first["condition"]:
        kind, keys = "experiment", [c for c in (first["entity"], first["condition"], first["replicate"]) if c]
    elif first["entity"] and first["version"]:
        kind, keys, ties = "documents_evidence", [first["entity"], first["version"]], [first["sequence"]]
    elif generic:
        kind, keys = "generic_records", generic
    ties = [c for c in ties if c and c not in keys]
    warnings = []
    for key in keys:
        ratio = sampled_unique_ratio(frame, ordinal, [key]).first()["unique_ratio"]
        if ratio < 0.999:
            warnings.append(f"{key}: not unique in the sample ({ratio:.0%})")
    if keys and sampled_unique_ratio(frame, ordinal, keys + ties).first()["unique_ratio"] < 0.999:
        warnings.append("composite key is not unique in the sample; the record hash is the final tie-break")
    if first["timestamp"]:
        warnings.append(f"{first['timestamp']}: verify the time zone; ambiguous dates are never coerced")
    status = "PROPOSAL" if kind else "BLOCKED_AMBIGUOUS_IDENTITY"
    return spark.createDataFrame(
        [(kind, status, keys, ties, "nulls_last", "block", warnings, True)],
        "detected_kind string, gate_status string, primary_keys array<string>, tie_break_keys array<string>, "
        "null_ordering string, duplicate_policy string, warnings array<string>, proposal_only boolean",
    )


def _tokens_of(name: str) -> list[str]:
    spaced = "".join(("_" + c) if c.isupper() and i and not name[i - 1].isupper() else c for i, c in enumerate(name))
    return [t for t in spaced.lower().replace("-", "_").replace(" ", "_").split("_") if t]
