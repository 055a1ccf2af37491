"""Whole tables as JSON records, as text, and as short previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.functions.text import PREVIEW_LENGTH, clip
from dataroute.functions.values import (
    RECORD_TIME_FORMAT,
    has_json_form,
    json_value,
    text_value,
)
from dataroute.sources.save import save

_RECORD_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": RECORD_TIME_FORMAT,
    "timestampNTZFormat": RECORD_TIME_FORMAT,
}


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column ``record``.

    Nulls are written out, NaN and infinities become null, times are ISO with
    milliseconds. A column of a type without a JSON form is written as text, which
    its type decides. The table stays distributed: this is one projection.
    """
    repeated = sorted({name for name in df.columns if df.columns.count(name) > 1})
    if repeated:
        raise ValueError(f"column names must be unique in records: {repeated}")
    values = [
        (json_value if has_json_form(field.dataType) else text_value)(value, field.dataType).alias(
            field.name
        )
        for value, field in _by_position(df)
    ]
    return _positional(df).select(
        F.to_json(F.struct(*values), _RECORD_OPTIONS).alias("record")
    )


def save_records(df: DataFrame, path: str, mode: str = "error", **options) -> None:
    """Write the records of ``df``, one per line."""
    save(to_records(df), path, "text", mode, **options)


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text; null and NaN become null."""
    values = [
        text_value(value, field.dataType).alias(field.name)
        for value, field in _by_position(df)
    ]
    return _positional(df).select(*values)


def preview(
    df: DataFrame, n: int = 20, order_by=None, length: int = PREVIEW_LENGTH
) -> DataFrame:
    """The first ``n`` rows as clipped text, by ``order_by`` for a stable answer."""
    head = (df if order_by is None else df.orderBy(order_by)).limit(n)
    texts = [
        clip(text_value(value, field.dataType), length).alias(field.name)
        for value, field in _by_position(head)
    ]
    return _positional(head).select(*texts)


def _positional(df: DataFrame) -> DataFrame:
    """Columns named by position, safe for dots, letter case and repeats."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _by_position(df: DataFrame):
    return [(F.col(f"c{i}"), field) for i, field in enumerate(df.schema.fields)]
