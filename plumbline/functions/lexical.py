"""Lexical value types and simple text predicates, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lexical patterns of the value types.
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
NUMBER_PATTERN = r"^[+-]?(?:[0-9]+\.[0-9]*|[0-9]*\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?$"
HASH_PATTERN = r"^[0-9a-f]{32,64}$"
ISO_DATE_TIME_PATTERN = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})"
    r"(?:.(?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?"
    r"(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9])?)?)?)?$"
)
ISO_WEEK_PATTERN = r"^[0-9]{4}-?W(?:0[1-9]|[1-4][0-9]|5[0-3])(?:-?[1-7])?$"


def is_iso_datetime(text: Column) -> Column:
    """ISO 8601 date or date-time whose calendar date exists; a bare number is not one."""
    digits = F.regexp_replace(F.substring(text, 1, 10), "-", "")
    day = F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd")
    shaped = text.rlike(ISO_DATE_TIME_PATTERN) & day.isNotNull()
    return (text.contains("-") | text.contains("T")) & (shaped | text.rlike(ISO_WEEK_PATTERN))


def text_type(text: Column) -> Column:
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "NULL")
        .when(text.rlike(INTEGER_PATTERN), "INTEGER")
        .when(text.rlike(NUMBER_PATTERN), "NUMBER")
        .when(F.lower(text).isin("true", "false"), "BOOLEAN")
        .when(is_iso_datetime(text), "DATETIME")
        .otherwise("STRING")
    )


def value_type(column: Column, dtype: T.DataType) -> Column:
    """NULL, BOOLEAN, INTEGER, NUMBER, DATETIME, STRING, OBJECT or ARRAY of one value."""
    if isinstance(dtype, T.StringType):
        return text_type(column)
    if isinstance(dtype, T.BooleanType):
        name = "BOOLEAN"
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        name = "INTEGER"
    elif isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        name = "NUMBER"
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        name = "DATETIME"
    elif isinstance(dtype, T.ArrayType):
        name = "ARRAY"
    elif isinstance(dtype, (T.StructType, T.MapType)):
        name = "OBJECT"
    elif isinstance(dtype, T.VariantType):
        shape = F.schema_of_variant(column)
        return (
            F.when(column.isNull() | (shape == "VOID"), "NULL")
            .when(shape == "STRING", text_type(F.try_variant_get(column, "$", "string")))
            .when(shape == "BOOLEAN", "BOOLEAN").when(shape == "BIGINT", "INTEGER")
            .when(shape.startswith("ARRAY"), "ARRAY").when(shape.startswith("OBJECT"), "OBJECT").otherwise("NUMBER")
        )
    else:
        name = "STRING"
    return F.when(column.isNull(), "NULL").otherwise(name)


def formula_like(text: Column) -> Column:
    """Starts like a spreadsheet formula and is not a signed number."""
    signed_number = text.rlike(r"^[+-]") & text.rlike(NUMBER_PATTERN)
    return F.coalesce(text.rlike(r"^[=+\-@]") & ~signed_number, F.lit(False))


def safe_csv_cell(text: Column) -> Column:
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def looks_like_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(HASH_PATTERN), F.lit(False))
