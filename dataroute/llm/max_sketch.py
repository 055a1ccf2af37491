"""Ranked lexical search with hashed max-sketches.

What a term adds to a document's score before its weight is the document's *impact* for
it. A sketch folds the impacts of all terms of a document into a few thousand coordinates,
to which terms are hashed, and keeps the largest of each. A query's weights laid on the
same coordinates and multiplied with a sketch give at least the document's score.

1. One pass counts documents, terms and the document frequencies of the queries' terms.
2. A second one makes the sketches, sparse: a coordinate and an impact per entry.
3. A batch of queries meets blocks of sketches as one matrix product. Per query the
   documents of a block are scored exactly from the largest bound down until the next bound
   is below the query's k-th best score so far; the others are provably worse. Thresholds
   are kept from block to block of a task.
4. The best of all tasks are merged, at most k rows per query and task.

Nothing but the statistics and the best rows leaves the task that reads a document. Batches
of queries have a bounded size; with more than one the sketches are written once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataroute.llm import hashing as H
from dataroute.llm.shipping import ship
from dataroute.llm.tables import written

K = 10
#: Coordinates of a sketch; documents of a block; queries of a batch, and their terms.
WIDTH = 4096
BLOCK_DOCUMENTS = 1024
BATCH_QUERIES, BATCH_TERMS = 512, 1 << 16
#: Documents scored at once, from the largest bound down.
STEP = 16
#: Bytes of text whose words are hashed at once.
TEXT_BYTES = 4 << 20

# Fixed by the contract: terms are runs of ASCII letters and digits and of all characters
# beyond ASCII; only A-Z are lowered. The same in SQL, for the queries.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INSIDE = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _INSIDE[_low : _high + 1] = False

STATISTICS = "term long, documents long, terms long"
FOUND = "query long, doc_id long, score long"
_ENTRY = np.dtype([("at", "<u2"), ("impact", "<u4")])


@dataclass
class Statistics:
    """Documents with a term, all their terms, and documents per hash of a query's term."""

    documents: int
    terms: int
    holders: dict[int, int]

    def weight(self, term: int) -> int:
        ratio = (2 * self.documents + 2) / (2 * self.holders.get(term, 0) + 1)
        return math.floor(1000 * math.log(ratio))

    def norm(self, terms: np.ndarray) -> np.ndarray:
        """What a document's number of terms adds below the line of its impacts."""
        return 100 - 90 + (90 * terms * self.documents) // self.terms


def impacts(counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 8 * norm)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item.

    Only scores above 0 count; equal ones rank by ascending doc_id, null ids last. A
    document that is there twice is two documents; an item that is there twice is ranked
    twice. A null, empty or termless text has no terms: such a document is never found and
    such an item finds nothing. A document of any length is scored whole by one task. Other
    columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    queries = items.select(
        F.col(item_id).cast("long").alias("item_id"),
        F.array_distinct(F.regexp_extract_all(lowered(F.col(item_text)), F.lit(TERM), F.lit(0))).alias("words"),
    ).withColumn("query", F.monotonically_increasing_id())
    queries = written(queries.filter(F.size("words") > 0), "items")
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    found = None
    batches = _batches(queries)
    sketches = None
    for batch in batches:
        own = [(x["query"], _hashes(x["words"])) for x in queries.filter(batch).collect()]
        if not own:
            continue
        counted = statistics(source, np.unique(np.concatenate([x for _, x in own])))
        if not counted.documents:
            break
        if sketches is None:
            sketches = sketch(source, counted)
            if len(batches) > 1:
                sketches = written(sketches, "sketches")
        best = _best(_lookup(sketches, own, counted, k), k)
        if len(batches) > 1:
            best = written(best, "best")
        found = best if found is None else found.unionAll(best)
    if found is None:
        found = spark.createDataFrame([], FOUND + ", rank int")
    return found.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def lowered(text: Column) -> Column:
    """``text`` with A-Z lowered, and nothing else."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), capitals, capitals.lower())


def _batches(queries: DataFrame) -> list[Column]:
    """Conditions that split the queries into batches of a bounded number and size."""
    row = queries.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("terms")).first()
    n = max(-(-row["n"] // BATCH_QUERIES), -(-(row["terms"] or 0) // BATCH_TERMS))
    return [F.pmod(F.xxhash64("query"), F.lit(n)) == k for k in range(n)]


def _hashes(words: list[str]) -> np.ndarray:
    data = [x.encode() for x in words]
    whole, begins = H.texts_as_bytes(data)
    return np.unique(H.word_hashes(whole, begins[:-1], begins[1:] - 1))


def statistics(source: DataFrame, terms: np.ndarray) -> Statistics:
    """Counts over all documents, and the documents that hold each of ``terms``."""
    shared = source.sparkSession.sparkContext.broadcast(np.sort(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        holders = np.zeros(len(wanted), np.int64)
        documents = total = 0
        for texts in _texts(batches, "text"):
            _, term, counts, begins = _terms(texts)
            documents += int((np.diff(begins) > 0).sum())
            total += int(counts.sum())
            at = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
            holders += np.bincount(at[wanted[at] == term], minlength=len(wanted))
        held = np.flatnonzero(holders)
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array([None, *wanted[held].view(np.int64).tolist()], pa.int64()),
                "documents": pa.array([documents, *holders[held].tolist()], pa.int64()),
                "terms": pa.array([total, *[0] * len(held)], pa.int64()),
            }
        )

    counted = source.select("text").mapInArrow(count, STATISTICS)
    # A row per term of the batch: bounded.
    rows = counted.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()
    whole = next((x for x in rows if x["term"] is None), None)
    return Statistics(
        whole["documents"] if whole else 0,
        whole["terms"] if whole else 0,
        {x["term"] & (1 << 64) - 1: x["documents"] for x in rows if x["term"] is not None},
    )


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[bytes]]:
    """Texts of a batch in portions of a bounded size, or one longer text."""
    for batch in batches:
        held, size = [], 0
        for text in batch.column(column).to_pylist():
            if held and size + len(text) > TEXT_BYTES:
                yield held
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield held


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of the distinct terms of each text, sorted by both; where each text's begin."""
    data, begins = H.texts_as_bytes(texts)
    data = H.LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _INSIDE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = H.word_hashes(data, start, end)
    owner = np.searchsorted(begins, start, "right") - 1
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)])
    counts = np.diff(np.r_[first, len(hashes)])
    return owner[first], hashes[first], counts, np.searchsorted(owner[first], np.arange(len(texts) + 1))


def coordinate(terms: np.ndarray) -> np.ndarray:
    return (terms >> H.U(40)).astype(np.int64) % WIDTH


def sketch(source: DataFrame, counted: Statistics) -> DataFrame:
    """All columns of ``source`` with ``terms``, a document's number of them, and ``sketch``.

    A sketch is a list of coordinates, ascending, and the largest impact of each.
    """
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in source.schema) + ", terms long, sketch binary"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches = [], []
            for texts in _texts(iter([batch]), "text"):
                owner, term, counts, begins = _terms(texts)
                terms = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
                impact = impacts(counts, counted.norm(terms)[owner])
                place = owner * WIDTH + coordinate(term)
                order = np.argsort(place, kind="stable")
                place, impact = place[order], impact[order]
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
                entries = np.empty(len(first), _ENTRY)
                entries["at"] = place[first] % WIDTH
                entries["impact"] = np.maximum.reduceat(impact, first) if len(first) else 0
                edges = np.searchsorted(place[first], np.arange(len(texts) + 1) * WIDTH)
                sizes += terms.tolist()
                sketches += [entries[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = {x: batch.column(x) for x in batch.schema.names}
            yield pa.RecordBatch.from_pydict(
                columns | {"terms": pa.array(sizes, pa.int64()), "sketch": pa.array(sketches, pa.binary())}
            )

    return source.mapInArrow(fold, schema)


class _Batch:
    """Queries: their terms and weights, and their weights by coordinate."""

    def __init__(self, queries: list[tuple[int, np.ndarray]], counted: Statistics, k: int):
        self.k = k
        self.counted = counted
        self.numbers = [x for x, _ in queries]
        self.terms = [x for _, x in queries]
        self.weights = [np.array([counted.weight(int(t)) for t in x], np.int64) for x in self.terms]
        used = np.unique(coordinate(np.concatenate(self.terms)))
        self.column = np.full(WIDTH, -1)
        self.column[used] = np.arange(len(used))
        self.matrix = np.zeros((len(used), len(queries)), np.float32)
        for q, (term, weight) in enumerate(zip(self.terms, self.weights, strict=True)):
            np.add.at(self.matrix[:, q], self.column[coordinate(term)], weight)
        # Per query the best so far: (score, id, whether there is one) from the best down.
        self.best: list[list[tuple]] = [[] for _ in queries]

    def bounds(self, sketches: list[bytes]) -> np.ndarray:
        """At least the score of every document for every query."""
        entries = np.frombuffer(b"".join(sketches), _ENTRY)
        owner = np.repeat(np.arange(len(sketches)), [len(x) // _ENTRY.itemsize for x in sketches])
        column = self.column[entries["at"]]
        used = column >= 0
        dense = np.zeros((len(sketches), len(self.matrix)), np.float32)
        dense[owner[used], column[used]] = entries["impact"][used]
        # Single precision, with more than its rounding added.
        return (dense @ self.matrix) * np.float32(1 + 1e-4)

    def take(self, ids: list[int | None], texts: list[bytes], sketches: list[bytes]) -> None:
        """Score what the bounds of a block leave, for every query from the largest bound down."""
        bounds = self.bounds(sketches)
        read: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for q in range(len(self.numbers)):
            own = bounds[:, q]
            likely = np.flatnonzero(own > 0)
            likely = likely[own[likely] >= self._threshold(q)]
            likely = likely[np.argsort(-own[likely], kind="stable")]
            for at in range(0, len(likely), STEP):
                if own[likely[at]] < self._threshold(q):
                    break
                step = likely[at : at + STEP].tolist()
                self._read(read, [i for i in step if i not in read], texts)
                scored = [(self._score(q, *read[i]), ids[i]) for i in step]
                kept = self.best[q] + [x for x in scored if x[0] > 0]
                self.best[q] = sorted(kept, key=_order)[: self.k]

    def _threshold(self, q: int) -> int:
        return self.best[q][-1][0] if len(self.best[q]) == self.k else 1

    def _read(self, read: dict, places: list[int], texts: list[bytes]) -> None:
        """The terms, counts and norms of documents that a query has to score."""
        if not places:
            return
        _, term, counts, begins = _terms([texts[i] for i in places])
        for i, a, b in zip(places, begins[:-1], begins[1:], strict=True):
            norm = int(self.counted.norm(int(counts[a:b].sum())))
            read[i] = term[a:b], counts[a:b], norm

    def _score(self, q: int, term: np.ndarray, counts: np.ndarray, norm: int) -> int:
        at = np.minimum(np.searchsorted(term, self.terms[q]), len(term) - 1)
        held = term[at] == self.terms[q]
        return int((self.weights[q][held] * impacts(counts[at[held]], norm)).sum())


def _order(found: tuple) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, doc_id or 0


def _lookup(
    sketches: DataFrame, queries: list[tuple[int, np.ndarray]], counted: Statistics, k: int
) -> DataFrame:
    shared = sketches.sparkSession.sparkContext.broadcast((queries, counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch(*shared.value, k)
        for rows in batches:
            for at in range(0, rows.num_rows, BLOCK_DOCUMENTS):
                block = rows.slice(at, BLOCK_DOCUMENTS)
                batch.take(*(block.column(x).to_pylist() for x in ("doc_id", "text", "sketch")))
        found = [
            (number, doc_id, score)
            for number, best in zip(batch.numbers, batch.best, strict=True)
            for score, doc_id in best
        ]
        yield pa.RecordBatch.from_pydict(
            {x: pa.array([y[n] for y in found], pa.int64()) for n, x in enumerate(("query", "doc_id", "score"))}
        )

    return sketches.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
