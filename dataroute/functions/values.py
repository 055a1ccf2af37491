"""Value functions: the JSON and the text form of a column, by its type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: time form of JSON records ----------------------------------
RECORD_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS"
# ------------------------------------------------------------------------------

_FLOATING = (T.DoubleType, T.FloatType)
_NUMBERS = (T.IntegralType, T.DecimalType, *_FLOATING)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_PLAIN = (*_NUMBERS, *_TIMES, T.BooleanType, T.StringType, T.BinaryType, T.NullType, T.VariantType)


def json_value(value: Column, kind: T.DataType) -> Column:
    """A value in the shape that its JSON record needs, at any nesting depth.

    NaN and infinities become null, dates become midnight timestamps and binary
    becomes UTF-8 text (bytes that are not UTF-8 become U+FFFD). Keys of maps
    become the text of such values. A type without a JSON form, or with a field
    name twice in one struct, is a ``ValueError``.
    """
    if not has_json_form(kind):
        raise ValueError(f"{kind.simpleString()} has no JSON form")
    if isinstance(kind, _FLOATING):
        return F.when(_is_finite(value), value)
    if isinstance(kind, T.DateType):
        return value.cast(T.TimestampNTZType())
    if isinstance(kind, T.BinaryType):
        return F.make_valid_utf8(value.cast("string"))
    if not _needs_change(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: json_value(item, kind.elementType))
    if isinstance(kind, T.MapType):
        if _needs_change(kind.valueType):
            value = F.transform_values(value, lambda _, item: json_value(item, kind.valueType))
        if _key_needs_change(kind.keyType):
            value = F.transform_keys(value, lambda key, _: _key_text(key, kind.keyType))
        return value
    fields = [
        json_value(value.getField(field.name), field.dataType).alias(field.name)
        for field in kind.fields
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def has_json_form(kind: T.DataType) -> bool:
    """Whether ``json_value`` takes values of this type; field names must be unique."""
    if isinstance(kind, T.ArrayType):
        return has_json_form(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, _PLAIN) and has_json_form(kind.valueType)
    if isinstance(kind, T.StructType):
        repeated = sorted({name for name in kind.names if kind.names.count(name) > 1})
        if repeated:
            raise ValueError(f"field names must be unique in records: {repeated}")
        return all(has_json_form(field.dataType) for field in kind.fields)
    return isinstance(kind, _PLAIN)


def text_value(value: Column, kind: T.DataType) -> Column:
    """A value as text; null and NaN are null."""
    if isinstance(kind, _FLOATING):
        return _float_text(value)
    if isinstance(kind, T.BooleanType):
        return F.initcap(value.cast("string"))
    return value.cast("string")


def _is_finite(value: Column) -> Column:
    # NaN sorts above infinity in Spark, so one bound excludes both.
    return F.abs(value) < float("inf")


def _needs_change(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _needs_change(kind.elementType)
    if isinstance(kind, T.MapType):
        return _needs_change(kind.valueType) or _key_needs_change(kind.keyType)
    if isinstance(kind, T.StructType):
        return any(_needs_change(field.dataType) for field in kind.fields)
    return isinstance(kind, (*_FLOATING, T.DateType, T.BinaryType))


def _key_needs_change(kind: T.DataType) -> bool:
    return isinstance(kind, (*_TIMES, T.BinaryType))


def _key_text(key: Column, kind: T.DataType) -> Column:
    """A map key as the text that its value would be; a record has no other keys."""
    if isinstance(kind, T.BinaryType):
        return F.make_valid_utf8(key.cast("string"))
    if isinstance(kind, T.DateType):
        return F.concat(key.cast("string"), F.lit("T00:00:00.000"))
    # Cut from the plain text: formatting a local time would go through a time zone.
    plain = key.cast("string")
    day, time = F.substring_index(plain, " ", 1), F.substring_index(plain, " ", -1)
    fraction = F.rpad(F.when(time.contains("."), F.substring_index(time, ".", -1)).otherwise(""), 3, "0")
    return F.concat(day, F.lit("T"), F.substring_index(time, ".", 1), F.lit("."), F.left(fraction, F.lit(3)))


def _float_text(value: Column) -> Column:
    """Plain digits from 1e-4 up to 1e16 and ``1e+16`` style beyond.

    Spark's own text turns to exponents at 1e-3 and 1e7 already.
    """
    spark_text = value.cast("string")
    size = F.abs(value)
    digits = F.rtrim(spark_text.cast("decimal(38, 21)").cast("string"), F.lit("0"))
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0")))
    exponent = F.regexp_replace(spark_text, r"(?:\.0)?E(\d)", "e+$1")
    exponent = F.regexp_replace(exponent, r"(?:\.0)?E-", "e-")
    exponent = F.regexp_replace(exponent, r"e([+-])(\d)$", "e$10$2")
    return (
        F.when(F.isnan(value), None)
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size >= 1e16) | ((size > 0) & (size < 1e-4)), exponent)
        .when((size >= 1e7) | ((size > 0) & (size < 1e-3)), F.coalesce(plain, digits))
        .otherwise(spark_text)
    )
