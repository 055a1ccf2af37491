"""Helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    """A column given by name or as an expression."""
    return value if isinstance(value, Column) else F.col(value)


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null when nothing matches.

    ``regexp_extract`` reports a miss as an empty string, and turning that into
    null would name (and so run) the regex twice; taking element 0 of the match
    list runs it once.
    """
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))
