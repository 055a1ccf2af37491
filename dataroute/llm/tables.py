"""Intermediate tables in the folder that all executors share, and joins on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.sources.scratch import scratch_location

#: No more keys than this can have that part of all rows each; these are broadcast.
MOST_HOT = 10_000
#: Keys with fewer rows are never hot.
LEAST_HOT = 1_000


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: later steps neither repeat its work nor depend
    on the executors that did it."""
    spark = df.sparkSession
    location = scratch_location(spark, label)
    df.write.parquet(location)
    return spark.read.schema(df.schema).parquet(location)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the facts of their key, one row per key, however many rows it has.

    ``size`` says how many of ``total`` rows a key has at most. Keys with a ten-thousandth
    of them or more, of which there are ten thousand at most, are broadcast, so that their
    rows stay where they are; only the others are shuffled. ``facts`` is read several
    times: give a written table.
    """
    bound = max(LEAST_HOT, total // MOST_HOT)
    hot = facts.filter(F.col(size) >= bound)
    if hot.isEmpty():
        return rows.join(facts, key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(
        others.join(facts.filter(F.col(size) < bound), key)
    )
