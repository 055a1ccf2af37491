"""Hard negatives by shared lists: exact inner products, certified ends of walks.

Anchors are clustered by direction. A shard of candidates is sorted once for each cluster,
by an upper bound on the inner product with any unit vector inside the cluster's cone: a
candidate's length times the cosine of its angle to the cluster's centre less the angle of
the cone. Every anchor of the cluster walks that one list. Times its own length, the bound
of the next candidate is at least any score that is still to come, so a walk ends for good
as soon as this is below what the anchor needs.

Two walks over all shards:

1. To the best rows of the anchor's own label, its positives. They are merged over shards,
   because what a negative is depends on a positive's score.
2. To the best rows of other labels inside each positive's window of scores. A walk ends
   below the window, or when the window's rows found so far are all better.

A task keeps its thresholds from shard to shard and returns at most the rows wanted per
anchor (or positive). Candidates stay in their tasks. Anchors come in blocks of a bounded
number, which are broadcast with their clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataroute.llm.shipping import ship
from dataroute.llm.tables import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window of a positive, in per cent of its score.
LOW, HIGH = 30, 90
#: Anchors that are broadcast together, anchors of a cluster (on average), candidates of a
#: shard, and candidates that a walk takes at a time.
BLOCK_ANCHORS, CLUSTER_ANCHORS, SHARD_ROWS, STEP = 4096, 16, 4096, 256
#: Rounds of clustering: any clusters give right results.
ROUNDS = 5
#: Candidates of a file of the table of vectors; a task reads one or more.
FILE_ROWS = 2 * SHARD_ROWS
#: Integers up to this are exact in single precision.
EXACT_SINGLE = 1 << 24
#: Keeps the rounding of angles from cutting a bound short.
ROUNDING = 1e-6
#: Below all scores, and its negative is a 64-bit integer too.
NONE = -(1 << 62)

FOUND = "anchor long, window int, vec_id long, score long"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as long; null where one is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.when(finite, F.transform(wide, lambda x: F.floor(F.lit(scale) * x).cast("long")))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row's score is its integer inner product with the anchor, of scaled components; higher
    ones come first, ties by smaller id, null ids last. An anchor's positives are its first
    rows of the same label; for each, the first rows of other labels whose score is within
    ``low`` to ``high`` per cent of the positive's are returned, all if there are fewer.

    Rows without a label or with a vector that is null or holds a null, an infinity or a
    NaN take no part. A shorter vector ends in zeros. Every other row is a candidate, rows
    that repeat an id or have none too; an anchor leaves out only its own row. Components
    are expected to be small enough for inner products below 2^53. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("string").alias("label"),
        scaled(F.col(embedding), scale).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).filter("label IS NOT NULL AND vector IS NOT NULL")
    total = vectors.count()
    files = max(1, -(-total // FILE_ROWS))
    dealt = rows.repartition(files, F.xxhash64("vec_id", "vector"))
    rows = written(dealt.withColumn("number", F.monotonically_increasing_id()), "vectors")
    anchors = rows.filter("is_anchor")
    blocks = -(-anchors.count() // BLOCK_ANCHORS)
    found = None
    for k in range(blocks):
        block = _Anchors.of(anchors.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == k).collect())
        if not block.ids:
            continue
        near = _merged(_walk(rows, block, _Walk(positives)), positives)
        chosen = [(x["anchor"], x["rank"], x["vec_id"], x["score"]) for x in near.collect()]
        own = _Walk(negatives, block.windows(chosen, low, high))
        mined = _merged(_walk(rows, block, own), negatives).selectExpr(
            "anchor", "window AS p", "rank", "vec_id AS negative_id", "score AS negative_score"
        )
        ids = dict(zip(block.numbers.tolist(), block.ids, strict=True))
        named = spark.createDataFrame(
            [(a, r, ids[a], i, s) for a, r, i, s in chosen],
            "anchor long, p int, anchor_id long, positive_id long, positive_score long",
        )
        result = mined.join(named, ["anchor", "p"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )
        if blocks > 1:
            result = written(result, "mined")
        found = result if found is None else found.unionAll(result)
    if found is None:
        names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], names)
    return found


@dataclass
class _Anchors:
    """A block of anchors, in clusters: members, centre and the angle of the cone."""

    numbers: np.ndarray
    ids: list
    labels: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    clusters: list[tuple[np.ndarray, np.ndarray, float]]

    @classmethod
    def of(cls, rows: list) -> _Anchors:
        rows = sorted(rows, key=lambda x: x["number"])
        width = max((len(x["vector"]) for x in rows), default=0)
        vectors = np.zeros((len(rows), width))
        for k, x in enumerate(rows):
            vectors[k, : len(x["vector"])] = x["vector"]
        lengths = np.linalg.norm(vectors, axis=1)
        return cls(
            np.array([x["number"] for x in rows], np.int64),
            [x["vec_id"] for x in rows],
            np.array([x["label"] for x in rows], object),
            vectors,
            lengths,
            _clusters(vectors / np.maximum(lengths, 1)[:, None]),
        )

    def windows(self, chosen: list[tuple], low: int, high: int) -> tuple[np.ndarray, ...]:
        """Per positive, by anchor: the anchor's place, the positive's rank, least and most score.

        A positive with a negative score has no window: its ends are the wrong way round.
        """
        place = {x: k for k, x in enumerate(self.numbers.tolist())}
        own = sorted((place[a], r, -(-low * s // 100), high * s // 100) for a, r, _, s in chosen)
        own = [x for x in own if x[2] <= x[3]]
        return tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) or (np.zeros(0, np.int64),) * 4


def _clusters(units: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Spherical k-means from evenly spaced rows."""
    if not len(units):
        return []
    count = -(-len(units) // CLUSTER_ANCHORS)
    centres = units[np.linspace(0, len(units) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        own = (units @ centres.T).argmax(axis=1)
        for c in range(count):
            total = units[own == c].sum(axis=0)
            if np.linalg.norm(total) > 0:
                centres[c] = total / np.linalg.norm(total)
    out = []
    for c in range(count):
        members = np.flatnonzero(own == c)
        if len(members):
            cosine = np.clip(units[members] @ centres[c], -1, 1)
            # A null vector has score 0 with everything, whatever its angle.
            inside = np.arccos(cosine[np.abs(units[members]).sum(axis=1) > 0])
            out.append((members, centres[c], float(inside.max(initial=0))))
    return out


@dataclass
class _Walk:
    """What is looked for: the best of the own label, or the best of others per window."""

    wanted: int
    windows: tuple[np.ndarray, ...] | None = None


def _walk(rows: DataFrame, block: _Anchors, walk: _Walk) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((block, walk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _State(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                state.take(batch.slice(at, SHARD_ROWS))
        yield state.found()

    return rows.select("number", "vec_id", "label", "vector").mapInArrow(run, FOUND)


class _State:
    """The best of a task so far, for a block of anchors."""

    def __init__(self, block: _Anchors, walk: _Walk):
        self.block, self.wanted = block, walk.wanted
        n = len(block.numbers)
        if walk.windows is None:
            self.owner, self.rank = np.arange(n), np.zeros(n, np.int64)
            self.low, self.high = np.full(n, NONE), np.full(n, -NONE)
            self.same = True
        else:
            self.owner, self.rank, self.low, self.high = walk.windows
            self.same = False
        #: Looked-for rows of an anchor: it has those from ``begins`` to the next.
        self.begins = np.searchsorted(self.owner, np.arange(n + 1))
        # From the best down; ``missing`` ranks rows without an id behind those with one.
        shape = (len(self.owner), self.wanted)
        self.score, self.id, self.missing = np.full(shape, NONE), np.zeros(shape, np.int64), np.ones(shape, bool)

    def take(self, shard: pa.RecordBatch) -> None:
        """Sort the shard once per cluster and let the cluster's anchors walk it."""
        block = self.block
        flat = shard.column("vector")
        sizes = flat.value_lengths().to_numpy()
        width = max(int(sizes.max(initial=0)), block.vectors.shape[1])
        vectors = np.zeros((shard.num_rows, width))
        inside = np.arange(width) < sizes[:, None]
        vectors[inside] = flat.flatten().to_numpy()
        own = np.zeros((len(block.numbers), width))
        own[:, : block.vectors.shape[1]] = block.vectors
        if np.abs(own).max(initial=0) * np.abs(vectors).max(initial=0) * width < EXACT_SINGLE:
            own, exact = own.astype(np.float32), vectors.astype(np.float32)
        else:
            exact = vectors
        ids = shard.column("vec_id")
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        numbers = shard.column("number").to_numpy()
        labels = np.array(shard.column("label").to_pylist(), object)
        lengths = np.linalg.norm(vectors, axis=1)
        for members, centre, cone in block.clusters:
            towards = vectors[:, : len(centre)] @ centre / np.maximum(lengths, 1e-300)
            angle = np.maximum(0, np.arccos(np.clip(towards, -1, 1)) - cone - ROUNDING)
            bound = lengths * np.cos(angle)
            order = np.argsort(-bound, kind="stable")
            bound = bound[order]
            walking = members
            for at in range(0, len(order), STEP):
                most = block.lengths[walking] * (bound[at] + ROUNDING * (1 + abs(bound[at])))
                walking = walking[most >= self._needed(walking)]
                if not len(walking):
                    break
                step = order[at : at + STEP]
                scores = np.rint(own[walking] @ exact[step].T).astype(np.int64)
                wanted = (labels[step] == block.labels[walking, None]) == self.same
                wanted &= numbers[step] != block.numbers[walking, None]
                scores = np.where(wanted, scores, NONE)
                for k, anchor in enumerate(walking.tolist()):
                    self._keep(anchor, scores[k], ids[step], missing[step])

    def _needed(self, anchors: np.ndarray) -> np.ndarray:
        """The least score that could still matter to each anchor."""
        needed = np.full(len(self.begins) - 1, np.inf)
        threshold = np.maximum(self.score[:, -1], self.low).astype(float)
        some = np.flatnonzero(np.diff(self.begins))
        if len(some):
            needed[some] = np.minimum.reduceat(threshold, self.begins[some])
        return needed[anchors]

    def _keep(self, anchor: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        for w in range(self.begins[anchor], self.begins[anchor + 1]):
            last = max(self.score[w, -1], self.low[w], NONE + 1)
            at = np.flatnonzero((scores >= last) & (scores <= self.high[w]))
            if not len(at):
                continue
            score = np.r_[self.score[w], scores[at]]
            own = np.r_[self.id[w], ids[at]]
            none = np.r_[self.missing[w], missing[at]]
            first = np.lexsort((own, none, -score))[: self.wanted]
            self.score[w], self.id[w], self.missing[w] = score[first], own[first], none[first]

    def found(self) -> pa.RecordBatch:
        w, k = np.nonzero(self.score > NONE)
        return pa.RecordBatch.from_pydict(
            {
                "anchor": pa.array(self.block.numbers[self.owner[w]], pa.int64()),
                "window": pa.array(self.rank[w], pa.int32()),
                "vec_id": pa.array(self.id[w, k], pa.int64(), mask=self.missing[w, k]),
                "score": pa.array(self.score[w, k], pa.int64()),
            }
        )


def _merged(found: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)
