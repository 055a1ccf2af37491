"""Connected components of a graph in a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.llm.tables import join_facts, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the least node that each node of ``edges`` can reach.

    Each round hangs the neighbours of a node on the least of them, first the larger
    ones, then the smaller ones. The number of rounds grows with the logarithm of the
    graph's size; every round is joins and grouping, and is written before the next. A
    node that most edges end at is not shuffled.
    Loops are ignored, and so are edges with a null end.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours hang on the least of the neighbours and the node.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        least = written(least, "least")
        larger = join_facts(both.filter("v > u"), least, "u", "n", 2 * mark[0])
        large = larger.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct(), "edges")
        # Small star: the node and its smaller neighbours hang on the least of these.
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        smaller = join_facts(large, least, "u", "n", mark[0])
        small = smaller.select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(
            small.unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges"
        )
        before, mark = mark, _mark(now)
        if before == mark:
            break
    # Now a star: every node hangs on the least of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
