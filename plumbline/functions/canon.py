"""Canonical JSON text of values and records, and hashes over it.

The canonical record is one JSON object: keys sorted by code point, no spaces,
UTF-8, one trailing newline. Numbers of type double print their shortest decimal
form (``900.0``, ``1e+16``, ``1e-05``), so a text, integer, boolean or double record
has one rendering no matter which table layout it came from.
Everything here is a JVM-side column expression.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Control characters whose JSON escape holds a hexadecimal letter: the JVM writes the
# letter in upper case, the canonical form in lower case.
_LETTERED_ESCAPES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def json_text(column: Column) -> Column:
    """A string as a JSON string literal with the surrounding quotes; NULL gives ``null``."""
    quoted = F.btrim(F.to_json(F.array(column)), F.lit("[]"))
    lowered = F.aggregate(
        F.array(*[F.lit(code) for code in _LETTERED_ESCAPES]),
        quoted,
        lambda text, code: F.regexp_replace(
            text,
            F.concat(F.lit(r"(?<!\\)((?:\\\\)*)\\u00"), code),
            F.concat(F.lit(r"$1\\u00"), F.lower(code)),
        ),
    )
    return F.when(column.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), lowered).otherwise(quoted)


def json_double(column: Column) -> Column:
    """Shortest decimal text of a double; non-finite values are refused."""
    size = F.abs(column)
    native = column.cast("string")
    padded = column.try_cast("decimal(38,21)").cast("string")
    trimmed = F.regexp_replace(padded, "0+$", "")
    plain = F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    mantissa = F.regexp_replace(F.substring_index(native, "E", 1), r"\.0$", "")
    power = F.substring_index(native, "E", -1).try_cast("int")
    digits = F.abs(power).cast("string")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
    return (
        F.when(column.isNull(), F.lit(None).cast("string"))
        .when((size >= 1e-3) & (size < 1e7) | (size == 0), native)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(F.isnan(column) | (size == float("inf")), F.raise_error(F.lit("DATA_JSON_CONSTANT_REFUSED")))
        .otherwise(scientific)
    )


def json_value(column: Column, dtype: T.DataType) -> Column:
    """Canonical JSON of one value; SQL NULL renders as ``null``."""
    return F.coalesce(_render(column, dtype), F.lit("null"))


def _render(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return json_text(column)
    if isinstance(dtype, T.DoubleType):
        return json_double(column)
    if isinstance(dtype, T.FloatType):
        return json_double(column.cast("string").cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit('"'), F.date_format(column, TIMESTAMP_PATTERN), F.lit('"'))
    if isinstance(dtype, T.DateType):
        return F.concat(F.lit('"'), F.date_format(column, "yyyy-MM-dd"), F.lit('"'))
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit('"'), F.lower(F.hex(column)), F.lit('"'))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(column, lambda item: json_value(item, dtype.elementType))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        pairs = F.transform(
            entries,
            lambda e: F.concat(
                json_text(e["key"].cast("string")), F.lit(":"), json_value(e["value"], dtype.valueType)
            ),
        )
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    if isinstance(dtype, T.StructType):
        inner = json_object({f.name: (column[f.name], f.dataType) for f in dtype.fields})
        return F.when(column.isNotNull(), inner)
    if isinstance(dtype, T.VariantType):
        return F.to_json(column)
    return column.cast("string")


def json_object(fields: Mapping[str, tuple[Column, T.DataType]]) -> Column:
    """One JSON object without the trailing newline."""
    parts: list[Column] = []
    for index, name in enumerate(sorted(fields)):
        column, dtype = fields[name]
        lead = ("," if index else "{") + quoted_key(name) + ":"
        parts += [F.lit(lead), json_value(column, dtype)]
    return F.concat(*(parts or [F.lit("{")]), F.lit("}"))


def quoted_key(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)


def canonical_record(frame: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Canonical text of the chosen columns (all by default), newline included."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    chosen = list(columns) if columns is not None else list(types)
    body = json_object({name: (F.col(f"`{name}`"), types[name]) for name in chosen})
    return F.concat(body, F.lit("\n"))


def record_hash(frame: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(canonical_record(frame, columns), 256)


def key_hash(frame: DataFrame, keys: Sequence[str]) -> Column:
    """Hash of the key list, NULL when any part is missing (NULL or empty text)."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    parts: list[Column] = []
    for index, name in enumerate(keys):
        value = F.concat(json_value(F.col(f"`{name}`"), types[name]), F.lit("\n"))
        parts += [F.lit("," if index else "["), json_text(value)]
    text = F.concat(*parts, F.lit("]\n"))
    return F.when(~any_missing(frame, keys), F.sha2(text, 256))


def is_missing(column: Column, dtype: T.DataType) -> Column:
    """Absent, NULL or empty text."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(column, F.lit("")) == ""
    return column.isNull()


def any_missing(frame: DataFrame, columns: Sequence[str]) -> Column:
    types = {f.name: f.dataType for f in frame.schema.fields}
    result = F.lit(False)
    for name in columns:
        result = result | is_missing(F.col(f"`{name}`"), types[name])
    return result


def record_hashes(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The table as one column of record hashes."""
    return frame.select(record_hash(frame, columns).alias("record_sha256"))


def bind_hash(frame: DataFrame, name: str = "record_sha256") -> DataFrame:
    """Add the hash of all the other columns to every row."""
    others = [c for c in frame.columns if c != name]
    return frame.select(*[F.col(f"`{c}`") for c in others], record_hash(frame, others).alias(name))


def broken_hashes(frame: DataFrame, name: str = "record_sha256") -> DataFrame:
    """Rows whose stored hash is not the hash of their other columns."""
    others = [c for c in frame.columns if c != name]
    actual = record_hash(frame, others)
    return frame.withColumn("actual_sha256", actual).filter(
        F.col(name).isNull() | (F.col(name) != F.col("actual_sha256"))
    )
