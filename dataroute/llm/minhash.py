"""Near duplicates by b-bit MinHash: bands for candidates, packed bits for estimates.

1. A document's sketch: the least value of its shingles under each of many hash functions.
   Groups of four minima are hashed to band keys; of each minimum only the low bits stay,
   packed into a signature of 40 bytes. Equal sets are one class and go on once.
2. Classes that share a band key are candidates. Inside a key their signatures are compared
   by counting bits: the share of equal minima, corrected for minima whose low bits agree
   by chance, estimates the similarity. Only classes whose estimate comes near the threshold
   are tied together, with one edge per class and key, never as pairs.
3. Tied classes are a group, and only their full sets are made again from the texts.
   ``groups.py`` confirms the links, splitting groups that exceed a task.

A pair at a similarity of 0.8 misses all 40 bands with a probability of 7e-10, and its
estimate falls below the margin with one of about 1e-10; every other step is exact.

A band key that very many classes share, as near copies of one text do, is not brought
together: its classes are tied to the least of them unseen, and step 3 decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.llm import hashing as H
from dataroute.llm.components import components
from dataroute.llm.filters import Filter
from dataroute.llm.groups import links_within
from dataroute.llm.shipping import ship
from dataroute.llm.tables import join_facts, written

#: Words of a shingle and least similarity, in per cent.
WORDS, PERCENT = 5, 80
#: Bands, minima of a band, and low bits that stay of a minimum.
BANDS, ROWS, BITS = 40, 4, 2
MINIMA = BANDS * ROWS
#: Standard deviations that an estimate may be below the threshold.
DEVIATIONS = 6.5
#: Classes of a band key that one task compares at most; band rows of a task.
MOST_IN_KEY, TASK_ROWS = 1 << 14, 1 << 16
#: Minima and shingles handled at once; bytes of text shingled at once.
_STRIP, _SHINGLES, _TEXT_BYTES = 16, 1 << 13, 4 << 20

SKETCHES = "doc_id long, n_shingles long, print binary, signature binary, bands array<long>"
TOKENS = "print binary, tokens binary"
EDGES = "a long, b long"

_random = np.random.Generator(np.random.PCG64(13))
_FLIPS = _random.integers(1 << 32, size=MINIMA, dtype=np.uint32)
_FACTORS = _random.integers(1 << 31, size=MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PAIRS = np.uint64(0x5555555555555555)


def near_copies(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every document.

    Words are runs of bytes other than ASCII white space with A-Z lowered; a document's
    set are its distinct runs of ``words`` words, or all its words as one if it has fewer.
    Two documents link when ``100 * intersection >= percent * union``; ``component_id`` is
    the smallest doc_id that links reach, and that document is ``kept``.

    A null text or one without words has an empty set, links with nothing and is kept. Every
    row is a document of its own, also one that repeats an id or a text; rows that have the
    component's id are kept. A null id counts as larger than all others and is kept only if
    no document with an id is reached. A text of any length is one sketch; its shingles are
    held by one task. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    sketches = written(source.mapInArrow(lambda batches: _sketch(batches, words), SKETCHES), "sketches")
    classes = (
        sketches.filter("n_shingles > 0")
        .groupBy("print")
        .agg(
            F.count("*").alias("n"),
            F.min("doc_id").alias("class_id"),
            *(F.first(x).alias(x) for x in ("n_shingles", "signature", "bands")),
        )
        .withColumn("number", F.monotonically_increasing_id())
    )
    classes = written(classes, "classes")
    tied = components(_candidates(classes, percent))
    groups = written(
        classes.select("number", "print").join(tied.withColumnRenamed("node", "number"), "number")
        .select("number", "print", F.col("component").alias("group")),
        "tied",
    )
    linked = components(links_within(_full_sets(source, groups, words), groups, percent))
    linked = written(
        classes.select("number", "class_id").join(linked.withColumnRenamed("node", "number"), "number"), "linked"
    )
    least = linked.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("members"))
    reached = join_facts(linked, written(least, "least"), "component", "members", linked.count())
    facts = classes.select("print", "n", "number", "class_id").join(
        reached.select("number", "component_id"), "number", "left"
    )
    facts = written(facts.select("print", "n", F.coalesce("component_id", "class_id").alias("component_id")), "facts")
    rows = sketches.select("doc_id", "n_shingles", "print")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    others = join_facts(rows.filter("n_shingles > 0"), facts, "print", "n", rows.count())
    return (
        others.select("doc_id", "n_shingles", "component_id")
        .unionAll(alone)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Edges that tie classes which share a band and whose estimate comes near the threshold."""
    rows = classes.select("number", F.explode("bands").alias("band"))
    keys = rows.groupBy("band").agg(F.count("*").alias("holders"), F.min("number").alias("least"))
    keys = written(keys.filter("holders > 1"), "bands")
    total = classes.count() * BANDS
    members = written(join_facts(rows, keys, "band", "holders", total), "members")
    many = members.filter(F.col("holders") > MOST_IN_KEY).selectExpr("number AS a", "least AS b")
    few = members.filter(F.col("holders") <= MOST_IN_KEY)
    n = max(1, -(-few.count() // TASK_ROWS))
    signed = few.select("number", "band").join(classes.select("number", "n_shingles", "signature"), "number")
    compared = (
        signed.withColumn("part", F.pmod(F.xxhash64("band"), F.lit(n)).cast("int"))
        .repartition(n, "part")
        .groupBy("part")
        .applyInArrow(lambda table: _estimate(table, percent), EDGES)
    )
    return compared.unionAll(many.filter("a != b"))


def _full_sets(source: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """``number, tokens``: the sets of the grouped classes, made again from their texts."""
    wanted = Filter(groups.select(F.conv(F.hex(F.left("print", F.lit(8))), 16, -10).cast("long")))
    shingled = source.select("text").mapInArrow(lambda batches: _tokens(batches, words, wanted), TOKENS)
    # A task gives a set once, so a text that very many rows have is a row per task here.
    sets = shingled.groupBy("print").agg(F.first("tokens").alias("tokens"))
    return written(sets.join(groups.select("print", "number"), "print").select("number", "tokens"), "full-sets")


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= _TEXT_BYTES):
            size += len(texts[end])
            end += 1
        (hashes,), first = H.words_of(texts[begin:end], lower=True)
        full = np.arange(max(0, len(hashes) - words + 1))
        grams = H.windows(hashes, full, words) if len(full) else hashes[:0]
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if high - low >= words:
                own = np.sort(grams[low : high - words + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]
            elif high > low:
                # Shorter than a shingle: its hash depends on the number of words.
                yield H.windows(hashes, np.array([low]), high - low, 100 + high - low)
            else:
                yield hashes[:0]
        begin = end


def minima(tokens: np.ndarray) -> np.ndarray:
    """The least value of the tokens under each hash function."""
    short = (tokens >> H.U(32)).astype(np.uint32)
    out = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), _SHINGLES):
        part = short[at : at + _SHINGLES]
        for k in range(0, MINIMA, _STRIP):
            own = slice(k, k + _STRIP)
            values = (part ^ _FLIPS[own, None]) * _FACTORS[own, None]
            np.minimum(out[own], values.min(axis=1), out=out[own])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key per band: equal where all minima of the band are."""
    keys = np.arange(BANDS, dtype=H.U)
    for row in least.reshape(BANDS, ROWS).T:
        keys = H.mix(keys * H.U(0x9E3779B97F4A7C15) + row)
    return keys


def packed_bits(least: np.ndarray) -> bytes:
    """The low bits of every minimum, after mixing, packed."""
    low = (H.mix(least.astype(H.U) + H.U(1) << H.U(8)) & H.U((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(low[:, None] >> np.arange(BITS, dtype=np.uint8) & 1).tobytes()


def estimates(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarities from packed signatures: equal minima beyond those expected by chance."""
    differ = own ^ others
    for k in range(1, BITS):
        differ |= (own ^ others) >> np.uint64(k)
    unequal = np.bitwise_count(differ & _PAIRS).sum(axis=-1)
    chance = 0.5**BITS
    return ((1 - unequal / MINIMA) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """What the estimate of a pair at the threshold stays above."""
    chance = 0.5**BITS
    equal = percent / 100 * (1 - chance) + chance
    deviation = (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)
    return percent / 100 - DEVIATIONS * deviation


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, signatures, bands = [], [], [], []
        for tokens in shingle_sets(batch.column("text").to_pylist(), words):
            sizes.append(len(tokens))
            prints.append(_print(tokens))
            least = minima(tokens) if len(tokens) else None
            signatures.append(packed_bits(least) if len(tokens) else None)
            bands.append(band_keys(least).view(np.int64) if len(tokens) else None)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array(sizes, pa.int64()),
                "print": pa.array(prints, pa.binary()),
                "signature": pa.array(signatures, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64())),
            }
        )


def _tokens(batches: Iterator[pa.RecordBatch], words: int, wanted: Filter) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        prints, sets = [], []
        for tokens in shingle_sets(batch.column("text").to_pylist(), words):
            own = _print(tokens)
            if len(tokens) and own not in seen and wanted.test(np.frombuffer(own[:8], ">i8").astype(np.int64))[0]:
                seen.add(own)
                prints.append(own)
                sets.append(tokens.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"print": pa.array(prints, pa.binary()), "tokens": pa.array(sets, pa.binary())}
        )


def _print(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _estimate(table: pa.Table, percent: int) -> pa.Table:
    """One edge per class that a search over near estimates reaches in a band key."""
    band, number = table.column("band").to_numpy(), table.column("number").to_numpy()
    order = np.lexsort((number, band))
    band, number = band[order], number[order]
    size = table.column("n_shingles").to_numpy()[order]
    packed = b"".join(table.column("signature").to_pylist())
    signature = np.frombuffer(packed, "<u8").reshape(len(order), -1)[order]
    near = least_estimate(percent)

    def alike(one, two) -> np.ndarray:
        small, large = np.minimum(size[one], size[two]), np.maximum(size[one], size[two])
        return (100 * small >= percent * large) & (estimates(signature[one], signature[two]) >= near)

    begins = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.zeros(0, np.int64)
    holders = np.diff(np.r_[begins, len(band)])
    # Most keys have two holders: these are compared all at once.
    two = begins[holders == 2]
    two = two[alike(two, two + 1)]
    a, b = [number[two]], [number[two + 1]]
    for begin, count in zip(begins[holders > 2].tolist(), holders[holders > 2].tolist(), strict=True):
        unreached = np.arange(begin, begin + count)
        while len(unreached) > 1:
            start, unreached = unreached[0], unreached[1:]
            queue = [start]
            while queue and len(unreached):
                reached = alike(queue.pop(), unreached)
                found, unreached = unreached[reached], unreached[~reached]
                queue += found.tolist()
                a.append(np.full(len(found), number[start]))
                b.append(number[found])
    edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return pa.table({"a": pa.array(edges[0], pa.int64()), "b": pa.array(edges[1], pa.int64())})
