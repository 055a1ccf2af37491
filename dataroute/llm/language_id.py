"""Language identification by the nearest of several centroids per language.

A text is the vector of its character n-grams: byte n-grams of the lowered text, hashed
into a fixed number of dimensions, weighted by TF-IDF and scaled to unit length. The
document frequencies are counted over every training document; centroids come from
spherical k-means within each language over a bounded sample. A text gets the language of
the centroid with the largest cosine, and is marked as rejected if that centroid is
further away than nearly all of its own sample was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataroute.llm import hashing as H
from dataroute.llm.shipping import ship
from dataroute.llm.tables import written

DIMENSIONS = 4096
SIZES = (1, 2, 3)
#: Documents per language that the centroids are fitted on, and centroids per language.
SAMPLE = 400
OVERSAMPLE = 4
CLUSTERS = 4
ROUNDS = 12
#: The share of a language's sample that a centroid stands for at least.
LEAST_SHARE = 0.04
#: The share of a centroid's own sample that lies within its radius.
WITHIN = 0.995
SLACK = 0.05
UNKNOWN = "und"
BATCH_BYTES = 1 << 18
#: Letters lowered, everything else in ASCII a blank; other scripts' bytes as they are.
LETTERS = np.array([x if x >= 0x80 or chr(x).isalpha() else 0x20 for x in H.LOWER], np.uint8)

SCHEMA = "doc_id long, held_out boolean, lang_pred string, nearest string, score double, rejected boolean"


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    radius: np.ndarray


def held_out(doc_id: str = "doc_id", modulus: int = 5, remainder: int = 0) -> Column:
    """Whether a document is kept from training; a null id is treated as an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def counts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """n-gram counts as ``(first text, matrix of texts by dimensions)``, a few texts at a time."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_BYTES) and to - at < 64:
            size += len(texts[to])
            to += 1
        data, begins = H.texts_as_bytes(texts[at:to])
        data = LETTERS[data]
        blank = data == 0x20
        gap = np.cumsum(np.r_[False, blank[1:] & blank[:-1]])  # up to here, pairs of blanks
        data = data.astype(np.uint32)
        owner = np.repeat(np.arange(to - at, dtype=np.int64), np.diff(begins)) * DIMENSIONS
        room = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(data))
        matrix = np.zeros((to - at) * DIMENSIONS, np.int64)
        gram = np.zeros(len(data), np.uint32)
        for size in range(1, max(SIZES) + 1):
            # A gram stays within its text and the blank behind it, and has no two blanks in turn.
            gram = gram[: len(data) - size + 1] * np.uint32(0x9E3779B1) + data[size - 1 :] + np.uint32(1)
            if size in SIZES:
                inside = (room[: len(gram)] >= size) & (gap[size - 1 :] == gap[: len(gram)])
                if size == 1:
                    inside &= ~blank
                slot = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
                matrix += np.bincount((owner[: len(gram)] + slot)[inside], minlength=len(matrix))
        yield at, matrix.reshape(-1, DIMENSIONS)
        at = to


def weigh(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of TF-IDF weights."""
    out = np.log1p(matrix).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        content.alias("text"),
        content.rlike(r"\p{L}").alias("letters"),
    )


def fit(
    docs: DataFrame,
    sample: int = SAMPLE,
    clusters: int = CLUSTERS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Model:
    """Document frequencies over all training documents, centroids from ``sample`` of each language.

    Rows without a language, and those that ``held_out`` names, null ids among them, teach
    nothing. Rows that repeat an id or a text are rows of their own, and no more of them than
    ``sample`` are taken. A null or empty text counts as a text without letters. What comes
    back to the driver are ``clusters`` centroids for each language that the column has.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.col(lang).alias("lang"),
    ).filter(F.col("lang").isNotNull() & ~held_out())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(DIMENSIONS, np.int64)
        total = 0
        for batch in batches:
            total += batch.num_rows
            for _, matrix in counts(_texts(batch, "text")):
                found += (matrix > 0).sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"slot": pa.array(np.arange(-1, DIMENSIONS), pa.int32()), "n": pa.array([total, *found], pa.int64())}
        )

    summed = rows.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = {x["slot"]: x["n"] for x in summed.collect()}
    df = np.array([got.get(k, 0) for k in range(DIMENSIONS)])
    idf = (np.log((1 + got.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)

    # A hash below a bound keeps a few times the sample of each language, however many
    # documents that has; of these the smallest hashes are taken, in every task first.
    # Rows are chosen, not ids: repeated ids, and repeated rows, add nothing to the bound.
    share = F.least(F.lit(1.0), F.lit(OVERSAMPLE * sample) / F.count("*"))
    bounds = written(rows.groupBy("lang").agg((share * F.lit(1 << 32)).cast("long").alias("bound")), "languages")
    mixed = F.xxhash64(F.lit("sample"), "doc_id", "text")
    first = Window.partitionBy("lang").orderBy("mixed", "doc_id", "text")
    # One narrow row per language: Spark broadcasts them unless that is very many.
    sampled = (
        rows.join(bounds, "lang")
        .withColumn("mixed", mixed)
        .filter(F.col("mixed").bitwiseAND(F.lit((1 << 32) - 1)) < F.col("bound"))
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= sample)
        .select("lang", "text")
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, matrix in counts(_texts(batch, "text")):
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array(langs[at : at + len(matrix)], pa.string()),
                        "vector": pa.array([x.astype("<f4").tobytes() for x in weigh(matrix, idf)], pa.binary()),
                    }
                )

    def fit_language(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = b"".join(sorted(x.as_py() for x in table.column("vector")))
        own = np.frombuffer(own, "<f4").reshape(-1, DIMENSIONS)
        found = _clusters(own, clusters)
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * len(found), pa.string()),
                "centroid": pa.array([c.astype("<f4").tobytes() for c, _ in found], pa.binary()),
                "radius": pa.array([_radius(members @ c) for c, members in found], pa.float64()),
            }
        )

    # A group is ``sample`` vectors; what comes back are ``clusters`` per language.
    fitted = (
        sampled.mapInArrow(vectors, "lang string, vector binary")
        .groupBy("lang")
        .applyInArrow(fit_language, "lang string, centroid binary, radius double")
        .collect()
    )
    fitted.sort(key=lambda x: (x["lang"], bytes(x["centroid"])))
    centroids = b"".join(bytes(x["centroid"]) for x in fitted)
    return Model(
        idf,
        np.frombuffer(centroids, "<f4").reshape(-1, DIMENSIONS),
        [x["lang"] for x in fitted],
        np.array([x["radius"] for x in fitted]),
    )


def _radius(cosines: np.ndarray) -> float:
    return float(1 - np.quantile(cosines, 1 - WITHIN) + SLACK)


def _clusters(vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spherical k-means from members spread over the range of likeness to their mean."""
    likeness = np.argsort(vectors @ vectors.mean(axis=0), kind="stable")
    places = (np.arange(k) + 0.5) / k * len(vectors)
    centres = vectors[np.unique(likeness[places.astype(int)])]
    for _ in range(ROUNDS):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        owner = np.argmax(vectors @ centres.T, axis=1)
        centres = np.array([vectors[owner == j].mean(axis=0) for j in np.unique(owner)])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    owner = np.argmax(vectors @ centres.T, axis=1)
    found = [(centres[j], vectors[owner == j]) for j in np.unique(owner)]
    # A few members far from all others are mislabelled texts, not a way to write.
    least = min(LEAST_SHARE * len(vectors), max(len(members) for _, members in found))
    return [(centre, members) for centre, members in found if len(members) >= least]


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The nearest centroid's language for every row.

    ``nearest`` is that language, ``score`` its cosine, ``rejected`` whether the text is
    further away than the centroid's radius, and ``lang_pred`` the language, or ``und`` if
    the text is null or has no letter. ``held_out`` tells rows on which nothing was fitted.
    Without any training document every prediction is ``und``. One row per input row;
    repeated and null ids are carried through, other columns are not read.
    """
    ship(docs.sparkSession)
    centroids = model.centroids.T.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            if model.languages:
                for at, matrix in counts(_texts(batch, "text")):
                    cosine = weigh(matrix, model.idf) @ centroids
                    best[at : at + len(matrix)] = cosine.argmax(axis=1)
                    score[at : at + len(matrix)] = cosine.max(axis=1)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            nearest = [model.languages[k] if k >= 0 else None for k in best]
            known = [n if n and x else UNKNOWN for n, x in zip(nearest, letters, strict=True)]
            far = [k < 0 or 1 - s > model.radius[k] for k, s in zip(best, score, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "lang_pred": pa.array(known, pa.string()),
                    "nearest": pa.array(nearest, pa.string()),
                    "score": pa.array(np.where(letters, np.clip(score, 0, 1), 0.0)),
                    "rejected": pa.array(far, pa.bool_()),
                }
            )

    return _prepared(docs, doc_id, text).mapInArrow(run, SCHEMA)
