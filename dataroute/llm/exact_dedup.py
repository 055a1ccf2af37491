"""Exact deduplication with two passes over a Bloom filter.

The first pass fills two bit planes: a slot is set in the first when some text's hash
falls on it and in the second when another one does too. A text can only have a copy if
all of its slots are set in the second plane. The second pass tests every text against
that plane: the others go straight through, and only possible copies are shuffled, by
their whole digest, so that a false positive costs a row of a shuffle and no error.

The planes have a bounded size and are broadcast. Beyond the number of texts for which
they are made the share of false positives grows until every row is shuffled; the result
is the same. What the first pass shuffles are slot numbers, so it follows the texts, not
the size of the planes times the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataroute.llm.shipping import ship
from dataroute.llm.tables import join_facts, written

#: Slots of the filter per text, hashes per text, and most slots (64 MB for a plane).
SLOTS_PER_TEXT = 16
HASHES = 3
MOST_SLOTS = 1 << 29
#: Slots of one part of the filter, which one task puts together.
PART_SLOTS = 1 << 20


def digest(text: str | Column) -> Column:
    """SHA-256 of the text in UTF-8, as lowercase hex; a null text is an empty one."""
    column = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(column.cast("string"), F.lit("")).cast("binary"), 256)


def possibly_repeated(digests: DataFrame, column: str = "digest") -> Column:
    """A condition on the hex digests in ``column``: false if the value occurs only once."""
    spark = digests.sparkSession
    ship(spark)
    total = digests.count()
    slots = PART_SLOTS
    while slots < min(MOST_SLOTS, SLOTS_PER_TEXT * total):
        slots *= 2
    plane = _second_plane(digests.select(F.col(column).alias("digest")), slots)
    shared = spark.sparkContext.broadcast(plane)

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        bits = np.frombuffer(shared.value, np.uint8)
        found = np.ones(len(values), bool)
        for slot in _slots(values, slots):
            found &= (bits[slot >> 3] >> (slot & 7)) & 1 == 1
        return pd.Series(found)

    return test(F.col(column))


def _slots(digests: pd.Series, slots: int) -> list[np.ndarray]:
    """The slots of each hex digest, from different parts of it."""
    raw = np.frombuffer(bytes.fromhex("".join(digests)), ">u4").reshape(-1, 8)
    return [raw[:, k].astype(np.int64) & (slots - 1) for k in range(HASHES)]


def _second_plane(digests: DataFrame, slots: int) -> bytes:
    """One bit per slot: at least two texts fall on it."""

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.concatenate(_slots(batch.column(0).to_pandas(), slots))
            slot, count = np.unique(found, return_counts=True)
            part = slot // PART_SLOTS
            begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = [
                (int(part[a]), _packed(slot[a:b], count[a:b]))
                for a, b in zip(begins, [*begins[1:], len(slot)], strict=True)
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([x[0] for x in rows], pa.int32()),
                    "fallen": pa.array([x[1] for x in rows], pa.binary()),
                }
            )

    def merge(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(PART_SLOTS, bool)
        again = np.zeros(PART_SLOTS, bool)
        for batch in batches:
            for payload in batch.column("fallen"):
                found = np.frombuffer(payload.as_buffer(), "<u4")
                slot = found >> 1
                again[slot[(found & 1 == 1) | seen[slot]]] = True
                seen[slot] = True
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([key[0].as_py()], pa.int32()),
                "plane": pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary()),
            }
        )

    merged = (
        digests.mapInArrow(fall, "part int, fallen binary")
        .groupBy("part")
        .applyInArrow(merge, "part int, plane binary")
    )
    planes = {row["part"]: bytes(row["plane"]) for row in merged.collect()}
    empty = bytes(PART_SLOTS // 8)
    return b"".join(planes.get(part, empty) for part in range(slots // PART_SLOTS))


def _packed(slot: np.ndarray, count: np.ndarray) -> bytes:
    """A number per slot within its part: the slot, and in the last bit whether it fell twice."""
    return (((slot % PART_SLOTS) << 1) | (count > 1)).astype("<u4").tobytes()


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: which of its equal texts stays.

    ``doc_id``, ``keep_id`` (the largest doc_id among equal texts), ``group_size``, ``kept``
    and ``text_sha256``. Texts are equal when identical. A null text counts as empty. A
    null doc_id is smaller than all others: its row is kept only if no document with an
    id has its text. Rows that repeat a doc_id and its text all count in ``group_size``
    and are all kept or all not, as the id is what names a document here. Other columns
    are not read.
    """
    rows = written(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(text).alias("digest")), "digests"
    )
    tested = rows.withColumn("maybe", possibly_repeated(rows))
    tested = written(tested, "tested")
    single = tested.filter("NOT maybe").select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    maybe = tested.filter("maybe").select("doc_id", "digest")
    groups = maybe.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    groups = written(groups, "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    joined = join_facts(maybe, groups, "digest", "group_size", total)
    joined = joined.select("doc_id", "digest", "keep_id", "group_size")
    return single.unionAll(joined).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one row per distinct text, with all their columns.

    Of equal texts the row with the largest doc_id stays (nulls last); of rows that agree
    in that too, repeated rows among them, the greatest in the order of its other columns
    does (as JSON text). Texts without a copy pass straight through.
    """
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])
    key, content = names[doc_id], names[text]
    rows = rows.withColumn("digest", digest(content))
    digests = written(rows.select("digest"), "digests")
    tested = rows.withColumn("maybe", possibly_repeated(digests))
    others = F.to_json(F.struct(*[F.col(x) for x in names.values() if x != content]))
    chosen = (
        tested.filter("maybe")
        .groupBy("digest")
        .agg(F.max_by(F.struct(*names.values()), F.struct(F.col(key).alias("key"), others)).alias("row"))
        .select("row.*")
    )
    kept = tested.filter("NOT maybe").select(*names.values()).unionAll(chosen)
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])
