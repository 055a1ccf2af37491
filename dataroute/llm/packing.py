"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Which lengths share a sequence depends only on how many pieces of each length there are,
and there are at most ``capacity`` lengths. So the plan is made from that histogram, as
runs: pieces number ``a`` to ``b`` of one length go to consecutive sequences at one
offset. A piece learns its place from its rank among the pieces of its length. Neither
the histogram nor the plan grows with the documents.

Pieces above a third of the capacity can meet at most twice in a sequence. They are
matched greedily: the longest left takes the longest partner that still fits. Shorter
pieces follow in falling order, each into the smallest gap that holds it.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dataroute.llm.shipping import ship
from dataroute.llm.tables import written

CAPACITY = 2048
END_ID = 0

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, seq long"
)
PLACED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, "
    "sequence_id long, offset long"
)
#: How byte-level tokenizers of this kind cut a text: fixed by the vocabulary file's format.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here all Unicode versions agree on what is a letter, a number or white space.
OTHER = regex.compile(r"[^\x00-ɏ]")


class Run(NamedTuple):
    """Pieces ``rank`` to ``rank + count`` of a length: ``each`` to a sequence, from ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length go, given how many there are of each."""
    left = {length: count for length, count in histogram.items() if count}
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: list[int] = []  # sorted, each with its groups of sequences in ``open_groups``
    open_groups: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def place(length: int, count: int, sequence: int, each: int, offset: int) -> None:
        runs.append(Run(length, used[length], count, sequence, each, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in open_groups:
                open_groups[gap] = []
                insort(gaps, gap)
            open_groups[gap].append((sequence, count))

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            fitting = [x for x in large[: bisect_left(large, min(length, capacity - length) + 1)] if left[x]]
            partner = fitting[-1] if fitting else None
            if partner == length and left[length] == 1:
                partner = fitting[-2] if len(fitting) > 1 else None
            if partner is None:
                count = left[length]
                place(length, count, sequences, 1, 0)
                leave(capacity - length, sequences, count)
            elif partner == length:
                count = left[length] // 2
                place(length, 2 * count, sequences, 2, 0)
                leave(capacity - 2 * length, sequences, count)
            else:
                count = min(left[length], left[partner])
                place(length, count, sequences, 1, 0)
                place(partner, count, sequences, 1, length)
                leave(capacity - length - partner, sequences, count)
            sequences += count

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                count = -(-left[length] // (capacity // length))
                leave(capacity, sequences, count)
                sequences += count
                continue
            gap = gaps[k]
            sequence, count = open_groups[gap].pop()
            if not open_groups[gap]:
                del open_groups[gap], gaps[k]
            each = min(gap // length, left[length])
            filled = min(count, left[length] // each)
            place(length, filled * each, sequence, each, capacity - gap)
            leave(gap - each * length, sequence, filled)
            leave(gap, sequence + filled, count - filled)
    return runs


class _Encoder:
    """Token ids as the tokenizers library gives them, with special tokens recognised.

    The merges of a byte-level vocabulary are its ids in rising order, so its ids serve as
    ranks for tiktoken, which is several times faster. Texts in which the two libraries
    could differ go to tokenizers: those that spell a special token and those with
    characters on which Unicode versions disagree.
    """

    def __init__(self, definition: str):
        settings = json.loads(definition)
        kept = sorted({*range(33, 127), *range(161, 173), *range(174, 256)})
        shown = kept + [b for b in range(256) if b not in kept]
        letters = {chr(b if b in kept else 256 + shown.index(b) - len(kept)): b for b in shown}
        special = {x["content"] for x in settings["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in piece): number
            for piece, number in settings["model"]["vocab"].items()
            if piece not in special
        }
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.fast = tiktoken.Encoding(
            "byte-level", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.exact = Tokenizer.from_str(definition)
        self.exact.no_truncation()
        self.exact.no_padding()

    def ids(self, text: str) -> np.ndarray:
        if self.special.search(text) or OTHER.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")


@cache
def _encoder(definition: str) -> _Encoder:
    return _Encoder(definition)


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    settings = json.loads(definition)
    cut = settings.get("pre_tokenizer") or {}
    if (
        settings.get("normalizer") is not None
        or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True)
    ):
        raise ValueError("a byte-level vocabulary without a normalizer is needed")
    return definition


def cut(
    docs: DataFrame,
    definition: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of the tokenised documents, numbered per length within each task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(definition), np.zeros(capacity + 1, np.int64)
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4")
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encoder.ids(content.as_py()), end])
                edge = len(ids) % capacity or min(len(ids), capacity)
                start = 0
                for piece in range(-(-len(ids) // capacity)):
                    own = ids[start:edge].tobytes()
                    row = (
                        key, piece, start, edge - start, zlib.crc32(own),
                        own if with_ids else None, part, int(seen[edge - start]),
                    )
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    seen[edge - start] += 1
                    start, edge = edge, edge + capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES
            )

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).mapInArrow(run, PIECES)


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "seq"]


def pack(
    docs: DataFrame,
    definition: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Places of all documents in sequences of ``capacity`` tokens.

    A document is its token ids and ``end_id`` behind them. Only documents that are longer
    than a sequence are cut, into full pieces; the first one takes what is left over.
    Returns per piece ``doc_id``, ``piece`` (from 0), ``start`` (ids of its document before
    it), ``length``, ``ids_crc32`` (of little-endian unsigned 32-bit ids), ``ids`` (those
    bytes, null unless ``with_ids``), ``sequence_id`` and ``offset``. Sequences have no
    gaps between their pieces.

    A null or empty text is the end id alone. Null and repeated ids, and repeated rows,
    are documents of their own. Other columns are not read. No documents, no rows.
    """
    pieces = written(cut(docs, definition, capacity, end_id, with_ids, doc_id, text), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {x["length"]: x["n"] for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity))
    table = np.array(runs, np.int64).reshape(-1, len(Run._fields)).T

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("seq"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, each, offset = table
        begins = (length << 48) + rank
        for batch in batches:
            own = batch.column("length").to_numpy()
            place = batch.column("rank").to_numpy()
            k = np.searchsorted(begins, (own << 48) + place, "right") - 1
            nth = place - rank[k]
            columns = {name: batch.column(name) for name in _NAMES[:6]}
            columns["sequence_id"] = pa.array(sequence[k] + nth // each[k])
            columns["offset"] = pa.array(offset[k] + nth % each[k] * own)
            yield pa.RecordBatch.from_pydict(columns)

    return ranked.select(*_NAMES[:6], "rank").mapInArrow(locate, PLACED)
