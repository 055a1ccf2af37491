"""Reports on redirecting a whole table of paths.

A third of the rows may name one path, and far more may share one destination.
Rows are first reduced per path, with map-side combining, so a hot path costs
each task one row; destinations are computed once per distinct path after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.functions.paths import base_name_first_dot, redirect_path
from dataroute.operators.joins import join_hot, written


def redirect_plan(
    df: DataFrame, path_col: str, bucket: str, run_id: str
) -> DataFrame:
    """``(path, base, destination, changed)`` for every distinct source path.

    Join it back on the path to see where each row of ``df`` goes.
    """
    return (
        df.select(F.col(path_col).alias("path"))
        .filter(F.col("path").isNotNull())
        .distinct()
        .select(
            "path",
            base_name_first_dot("path").alias("base"),
            redirect_path("path", bucket, run_id).alias("destination"),
        )
        .withColumn("changed", F.col("destination") != F.col("path"))
    )


def redirect_rows(df: DataFrame, path_col: str, bucket: str, run_id: str) -> DataFrame:
    """Every row of ``df`` with ``destination`` and ``n_paths``, the paths that meet there.

    Destinations and counts are made once per distinct path and joined back. A path that
    very many rows have stays where it is, and so does a destination that very many paths
    have: these are measured and their facts, a bounded number, broadcast. Rows without a
    path have nulls. ``df`` is read several times: give a scanned or written table.
    """
    taken = {"destination", "n_paths"} & set(df.columns)
    if taken:
        raise ValueError(f"columns are there already: {sorted(taken)}")
    paths = written(redirect_plan(df, path_col, bucket, run_id).select("path", "destination"), "paths")
    meet = written(paths.groupBy("destination").agg(F.count(F.lit(1)).alias("n_paths")), "destinations")
    facts = written(join_hot(paths, meet, "destination"), "facts")
    return join_hot(df, facts.withColumnRenamed("path", path_col), path_col, "left").select(
        *(F.col(f"`{x}`") for x in df.columns), "destination", "n_paths"
    )


def redirect_collisions(
    df: DataFrame, path_col: str, bucket: str, run_id: str
) -> DataFrame:
    """``(destination, n_paths, n_rows)`` where several source paths would meet.

    ``n_paths`` is exact. The second shuffle carries partial counts only, one row
    per destination and task, however many paths share the destination.
    """
    per_path = (
        df.select(F.col(path_col).alias("path"))
        .filter(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_path.groupBy(redirect_path("path", bucket, run_id).alias("destination"))
        .agg(
            F.count(F.lit(1)).alias("n_paths"),
            F.sum("n").alias("n_rows"),
        )
        .filter(F.col("n_paths") > 1)
    )
