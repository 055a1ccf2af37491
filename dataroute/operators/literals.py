"""Literals and calls found in a table of texts, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataroute.functions.paths import base_name_first_dot
from dataroute.functions.text import (
    TARGET_METHOD,
    called_literals,
    literal_content,
    quoted,
    unquoted,
)


def quoted_literals(df: DataFrame, text_col: str) -> DataFrame:
    """``(other columns, pos, quote, literal)`` for every quoted literal.

    The text itself is left out: repeating it for each of its literals would
    multiply the table. Join on a key to have it back.
    """
    found = _exploded(df, text_col, quoted(text_col))
    return found.select(
        *_other_columns(df, text_col),
        "pos",
        F.left("found", F.lit(1)).alias("quote"),
        unquoted("found").alias("literal"),
    )


def call_literals(
    df: DataFrame,
    text_col: str,
    method: str = TARGET_METHOD,
    destination: Column | None = None,
) -> DataFrame:
    """``(other columns, pos, literal, base)`` for every ``.method("literal"`` call.

    ``destination``, usually ``unique_path(...)``, is evaluated once per call and
    added as a column of that name.
    """
    # Texts that never name the method cost one substring search, no regex.
    named = df.filter(F.col(text_col).contains(method))
    found = _exploded(named, text_col, called_literals(text_col, method))
    calls = found.select(
        *_other_columns(df, text_col), "pos", literal_content("found").alias("literal")
    ).withColumn("base", base_name_first_dot("literal"))
    if destination is not None:
        calls = calls.withColumn("destination", destination)
    return calls


def _exploded(df: DataFrame, text_col: str, items: Column) -> DataFrame:
    return df.select(
        *_other_columns(df, text_col), F.posexplode(items).alias("pos", "found")
    )


def _other_columns(df: DataFrame, text_col: str) -> list[Column]:
    return [
        F.col("`" + name.replace("`", "``") + "`")
        for name in df.columns
        if name != text_col
    ]
