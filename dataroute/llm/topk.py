"""Exact top-k search by inner product, with MaxScore pruning in shards.

A component of a vector is a term, its value the term's weight. Taken from the least value
that a term has in the shard, each term adds between 0 and a bound to a query's score. The
terms with the largest bounds are essential: without them nothing left can reach the
query's k-th best score so far. A shard scores the essential terms of all its vectors,
then probes the other terms, largest bound first, only for vectors that can still reach
the k best. Vectors that are dropped on the way have provably lower scores.

Queries and vectors are cut into blocks; a task sees one block of each, so memory is
bounded whatever the number of rows. The best of each cell are merged per query.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataroute.llm.shipping import ship
from dataroute.llm.tables import written

K = 20
SCALE = 64
#: Rows of a shard and of a block of queries.
SHARD_ROWS, QUERY_ROWS = 8192, 512
#: Vectors scored in full first, to have a threshold; terms probed at once; the share of
#: pairs from which on each is probed by itself.
SEED_ROWS, PROBE, SPARSE = 512, 12, 0.02
#: Integers below this are exact in single precision.
EXACT_SINGLE = 1 << 24

FOUND = "query long, query_id long, vec_id long, score long"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as long; null where a component is not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.when(finite, F.transform(wide, lambda x: F.floor(F.lit(scale) * x).cast("long")))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best vectors of each query.

    Queries are the rows for which ``is_query`` holds; candidates are all rows but the
    query's own. Scores are integer inner products of the scaled components, ties go to the
    smaller id, null ids last, and a query with fewer candidates gets them all.

    Rows with a vector that is null or holds a null, an infinity or a NaN take no part. A
    shorter vector ends in zeros. Rows that repeat an id, or have none, are candidates of
    their own; of queries that repeat an id each has its own ranks. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        scaled(F.col(embedding), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    ).filter(F.col("vector").isNotNull())
    # Rows are told apart by a number, fixed by writing.
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()), "vectors")
    total = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    shards = max(1, math.ceil(total["n"] / SHARD_ROWS))
    query_blocks = max(1, math.ceil(total["q"] / QUERY_ROWS))
    place = F.xxhash64("number")
    candidates = rows.select(
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
        "number",
        "vec_id",
        "vector",
    )
    queries = rows.filter("is_query").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(place, F.lit(query_blocks)).cast("int").alias("query_block"),
        "number",
        "vec_id",
        "vector",
    )
    cell = ["query_block", "shard"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cell(left, right, k)

    found = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(best, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Components as doubles, in which sums of their products are exact."""
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    if len(flat):
        out[np.repeat(np.arange(len(flat)), sizes), np.concatenate([np.arange(s) for s in sizes])] = (
            flat.flatten().to_numpy()
        )
    return out


def _cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The best of one shard for each query of one block."""
    if not queries.num_rows or not candidates.num_rows:
        return pa.table({x: pa.array([], pa.int64()) for x in ("query", "query_id", "vec_id", "score")})
    width = max(int(pc.max(pc.list_value_length(t.column("vector"))).as_py()) for t in (queries, candidates))
    # In the order of ties, so that a candidate's place stands for its id.
    order = pc.sort_indices(candidates, [("vec_id", "ascending")], null_placement="at_end")
    candidates = candidates.take(order)
    rows = _matrix(candidates.column("vector"), width)
    own = _matrix(queries.column("vector"), width)
    low, high = rows.min(axis=0), rows.max(axis=0)
    # What each term adds to a score at least, and at most beyond that.
    least = np.minimum(own * low, own * high)
    bound = np.maximum(own * low, own * high) - least
    if np.abs(own).max(initial=0) * np.abs(rows).max(initial=0) * width < EXACT_SINGLE / 4:
        rows, own, least, bound = (x.astype(np.float32) for x in (rows, own, least, bound))
    every = np.arange(len(own))
    terms = np.argsort(-bound, axis=1, kind="stable")
    rank = np.argsort(terms, axis=1)  # of each term among a query's terms
    ranked = np.take_along_axis(bound, terms, axis=1)
    # What the terms from each rank on can add together, and all of them at least.
    rest = np.concatenate([np.cumsum(ranked[:, ::-1], axis=1)[:, ::-1], np.zeros((len(own), 1))], axis=1)
    base = least.sum(axis=1)
    place = {x: k for k, x in enumerate(candidates.column("number").to_pylist())}
    itself = np.array([place.get(x, -1) for x in queries.column("number").to_pylist()])

    def kth(scores: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """The k-th best of each row; scores so far are lower bounds, so it only rises."""
        at = scores.shape[1] - k - 1  # one of them may be the query's own
        return threshold if at < 0 else np.maximum(threshold, np.partition(scores, at, axis=1)[:, at])

    threshold = kth(own @ rows[:SEED_ROWS].T, np.full(len(own), -np.inf, own.dtype))
    # Essential: the fewest leading terms without which the threshold is out of reach.
    done = np.clip((rest + base[:, None] >= threshold[:, None]).sum(axis=1), 1, width)
    chosen = rank < done[:, None]
    score = np.where(chosen, own, 0) @ rows.T + (least * ~chosen).sum(axis=1)[:, None]
    for step in itertools.count():
        live = score >= (threshold - rest[every, done])[:, None]
        if (done == width).all() or live.sum() <= live.size * SPARSE:
            break
        # Most vectors are still competitive: the next terms are probed for all at once.
        further = np.minimum(done + PROBE, width)
        chosen = (rank >= done[:, None]) & (rank < further[:, None])
        score += np.where(chosen, own, 0) @ rows.T - (least * chosen).sum(axis=1)[:, None]
        done = further
        if step % 2:
            threshold = kth(score, threshold)
    live[every[itself >= 0], itself[itself >= 0]] = False
    query, at = np.nonzero(live)
    total, seen = score[query, at].astype(np.float64), done[query]
    while len(at) and (seen < width).any():
        # Few are left: each is probed by itself, term by term.
        more = seen < width
        term = terms[query[more], seen[more]]
        total[more] += rows[at[more], term] * own[query[more], term] - least[query[more], term]
        seen = np.minimum(seen + 1, width)
        keep = total + rest[query, seen] >= threshold[query]
        at, query, total, seen = at[keep], query[keep], total[keep], seen[keep]
    order = np.lexsort((at, -total, query))
    at, query, total = at[order], query[order], total[order]
    begins = np.searchsorted(query, every)
    best = np.arange(len(query)) - begins[query] < k
    return pa.table(
        {
            "query": queries.column("number").take(pa.array(query[best])),
            "query_id": queries.column("vec_id").take(pa.array(query[best])),
            "vec_id": candidates.column("vec_id").take(pa.array(at[best])),
            "score": pa.array(np.rint(total[best]).astype(np.int64)),
        }
    )
