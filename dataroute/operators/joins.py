"""Joins whose hot keys are measured and stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.sources.scratch import scratch_location

#: No more keys than this can have that part of all rows each; these are broadcast.
MOST_HOT = 10_000
#: Keys with fewer rows are never hot.
LEAST_HOT = 1_000
#: Rows that take long go into files of as many at most.
MOST_ROWS = 16_384


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, so that later steps do not repeat its work."""
    location = scratch_location(df.sparkSession, label)
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


def spread(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` in files for every core, written and read back.

    For tables of few bytes whose rows take long: Spark deals those out by their bytes, and a
    group of rows in a file goes to one task however many rows it has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rounds = -(-df.count() // (cores * MOST_ROWS))
    return written(df.repartition(cores * max(1, rounds)), label)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that a ten-thousandth of all rows or more have: ten thousand at most.

    Rows are counted per task before anything is shuffled; nulls are no key.
    """
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    counted = written(counted, "counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    bound = max(LEAST_HOT, total // MOST_HOT)
    return written(counted.filter((F.col("n") >= bound) & F.col(key).isNotNull()).select(key), "hot")


def join_hot(
    rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """``rows`` joined with ``facts``, one row per ``key``, however many rows a key has.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Facts of hot keys are
    broadcast, which is a bounded number; their rows are not shuffled. The other rows join
    as Spark chooses. Both sides are read several times: give written or scanned tables.
    ``hot``, from ``hot_keys``, saves measuring the keys of the same rows, or of a part of
    them, again.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if hot.isEmpty():
        return rows.join(facts, key, how)
    hot_facts = written(facts.join(F.broadcast(hot), key, "left_semi"), "hot-facts")
    own = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_facts), key, how)
    others = rows.join(F.broadcast(hot), key, "left_anti")
    return own.unionByName(others.join(facts.join(F.broadcast(hot), key, "left_anti"), key, how))
