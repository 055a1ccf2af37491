"""Rows that may have one of many keys, told without moving rows: a Bloom filter."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataroute.llm.shipping import ship

#: Slots of the filter per key, slots that a key sets, and most slots (64 MB).
SLOTS_PER_KEY = 16
PROBES = 3
MOST_SLOTS = 1 << 29
#: Slots of one part of the filter, which one task puts together.
PART_SLOTS = 1 << 20


class Filter:
    """A test of 64-bit hashes: false only if none of the given ones is equal.

    The filter has a bounded size. With far more hashes than it is made for the test holds
    for ever more rows; nothing that follows may rely on more than its "no".
    """

    def __init__(self, hashes: DataFrame):
        """``hashes`` has one long column."""
        spark = hashes.sparkSession
        ship(spark)
        hashes = hashes.toDF("hash")
        self.slots = PART_SLOTS
        total = hashes.count()
        while self.slots < min(MOST_SLOTS, SLOTS_PER_KEY * total):
            self.slots *= 2
        low, high = F.expr("hash & 4294967295"), F.expr("shiftrightunsigned(hash, 32)")
        probes = F.array(*((low + F.lit(k) * high) % F.lit(self.slots) for k in range(PROBES)))
        fallen = hashes.select(F.explode(probes).alias("slot")).selectExpr(
            f"CAST(slot DIV {PART_SLOTS} AS INT) AS part", f"CAST(slot % {PART_SLOTS} AS INT) AS place"
        )
        merged = fallen.distinct().groupBy("part").applyInArrow(_plane, "part int, plane binary")
        planes = {row["part"]: bytes(row["plane"]) for row in merged.collect()}
        empty = bytes(PART_SLOTS // 8)
        self.planes = spark.sparkContext.broadcast(
            b"".join(planes.get(part, empty) for part in range(self.slots // PART_SLOTS))
        )

    def test(self, hashes: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.planes.value, np.uint8)
        hashes = hashes.view(np.uint64)
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        found = np.ones(len(hashes), bool)
        for k in range(PROBES):
            slot = (low + np.uint64(k) * high) % np.uint64(self.slots)
            found &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _plane(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    filled = np.zeros(PART_SLOTS, bool)
    filled[table.column("place").to_numpy()] = True
    plane = np.packbits(filled, bitorder="little").tobytes()
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "plane": pa.array([plane], pa.binary())})


def maybe_among(keys: DataFrame) -> Callable[..., Column]:
    """A test of columns like those of ``keys``: false only if no row has these values."""
    held = Filter(keys.select(F.xxhash64(*keys.columns)))

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(held.test(hashes.to_numpy()))

    return lambda *columns: test(F.xxhash64(*columns))
