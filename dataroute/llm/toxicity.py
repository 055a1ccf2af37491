"""Toxic spans by a linear-chain conditional random field, and scores from its marginals.

Labels are per document, the chain tags tokens. Token labels come from telling features:
whole words and word beginnings that are in toxic documents more often than chance explains,
whatever share of them that is. Their tokens in toxic documents are the labelled ones. The
field is trained on windows around them and on windows of clean documents; its weights
settle features that clean documents have too.

Only tokens with a weighted feature tell the chain anything new. A run of other tokens is
one power of the transition matrix, so a text costs one lookup per token and one step of
forward-backward per informative token, however long it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataroute.llm.shipping import ship
from dataroute.llm.tables import written

#: Labelled documents of each class that the model is fitted on, chosen by a hash of the id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 3000, 6000
#: Characters of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Of the features that are called telling, this part may be in toxic documents by chance.
FALSE_SHARE = 0.05
#: Windows per document, tokens on both sides of a labelled one, passes of training.
WINDOWS, REACH, ROUNDS, L2 = 4, 6, 150, 1e-4
THRESHOLD = 0.3
#: A token whose marginal reaches this is offending.
OFFENDING = 0.5
#: Added to evidence before its logarithm is taken; the doubt that always remains of a word.
FLOOR, LEAST_DOUBT = 0.05, 1e-3
KNOWN_TOKENS = 150_000

TOKEN = re.compile(r"[^\W_]+")
SCHEMA = (
    "doc_id long, held_out boolean, score double, predicted int, "
    "spans array<struct<start: int, end: int, marginal: double>>"
)


class Model(NamedTuple):
    weights: dict[str, float]  # log-odds of a feature for "toxic"
    bias: float
    transitions: np.ndarray  # 2 x 2 potentials in logs, from row to column
    start: np.ndarray  # potentials in logs of the first tag
    calibration: tuple[float, float] = (0.0, 1.0)  # from evidence in logs to log-odds


def held_out(doc_id: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether labels of a document are kept from training; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]


def _words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """Learn from a bounded sample of the labelled documents that are not held out.

    A document with several labels is toxic if one says so; null labels say nothing.
    Without a toxic and a clean document every score is 0.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        marked.filter("label = 1").orderBy(*order).limit(TOXIC_SAMPLE)
        .unionAll(marked.filter("label = 0").orderBy(*order).limit(CLEAN_SAMPLE))
    )
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).join(F.broadcast(chosen), "doc_id")  # at most TOXIC_SAMPLE + CLEAN_SAMPLE rows

    def with_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [_kind(_words(content)) for content in batch.column("text").to_pylist()]
            yield batch.append_column("kind", pa.array(kinds, pa.int64()))

    rows = rows.select("doc_id", "text", "label")
    rows = written(rows.mapInArrow(with_kind, "doc_id long, text string, label int, kind long"), "labelled")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for content, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own = {f for word in set(_words(content)) for f in features(word)}
                (toxic if mark else clean).update(own)
        every = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict(
            {
                "feature": pa.array(every, pa.string()),
                "toxic": pa.array([toxic[x] for x in every], pa.int64()),
                "clean": pa.array([clean[x] for x in every], pa.int64()),
            }
        )

    tallied = written(
        rows.select("text", "label")
        .mapInArrow(tally, "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "features",
    )
    n_toxic = rows.filter("label = 1").select("kind").distinct().count()
    n_clean = rows.filter("label = 0").count()
    share = n_toxic / max(1, n_toxic + n_clean)
    least = -math.log(FALSE_SHARE)
    # Near copies count once below, which only lowers the number of toxic documents.
    most = _surprise(F.least("toxic", F.lit(n_toxic)), F.col("clean"), share)
    candidates = {x["feature"] for x in tallied.filter(most >= least).select("feature").collect()}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, found = [], []
            for content, kind in zip(batch.column("text").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                own = {f for word in set(_words(content)) for f in features(word)} & candidates
                kinds += [kind] * len(own)
                found += own
            yield pa.RecordBatch.from_pydict(
                {"feature": pa.array(found, pa.string()), "kind": pa.array(kinds, pa.int64())}
            )

    kinds = (
        rows.filter("label = 1")
        .select("text", "kind")
        .mapInArrow(hits, "feature string, kind long")
        .distinct()
        .groupBy("feature")
        .agg(F.count("*").alias("kinds"))
    )
    judged = kinds.join(tallied, "feature").select(
        "feature", _surprise(F.col("kinds"), F.col("clean"), share).alias("surprise")
    )
    telling = _telling([tuple(x) for x in judged.filter(F.col("surprise") >= least).collect()], tallied.count())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(x).to_pylist() for x in ("doc_id", "text", "label"))
            for key, content, mark in zip(*columns, strict=True):
                words = _words(content)
                found = [i for i, word in enumerate(words) if not telling.isdisjoint(features(word))]
                marked_places = set(found) if mark else set()
                if mark:
                    middles = found[:WINDOWS]
                else:  # clean words that share a feature teach the most, then any
                    middles = found[:WINDOWS] or ([key * 7919 % len(words)] if words else [])
                for middle in middles:
                    low = max(0, middle - REACH)
                    part = words[low : middle + REACH + 1]
                    tags = [int(low + k in marked_places) for k in range(len(part))]
                    out.append({"words": part, "tags": tags})
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOW)

    sample_rows = rows.select("doc_id", "text", "label")
    sampled = sample_rows.mapInArrow(windows, "words array<string>, tags array<int>").collect()
    model = _train(sorted((tuple(x["words"]), tuple(x["tags"])) for x in sampled))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            found = [tagger.judge(_words(x))[2] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"label": batch.column("label"), "evidence": pa.array(found, pa.float64())}
            )

    judged = rows.select("text", "label").mapInArrow(judge, "label int, evidence double").collect()
    return model._replace(calibration=_calibrate(sorted((x["evidence"], x["label"]) for x in judged)))


def _surprise(toxic: Column, clean: Column, share: float) -> Column:
    """Chernoff's bound, as a negative logarithm, on the chance that of ``toxic + clean``
    documents so many are toxic if ``share`` of all are; 0 if no more than expected."""
    n = toxic + clean
    part = F.when(clean > 0, clean * F.log(clean / (n * (1 - share)))).otherwise(0.0)
    return F.when(toxic > n * share, toxic * F.log(toxic / (n * share)) + part).otherwise(0.0)


def _telling(surprises: list[tuple[str, float]], n_features: int) -> set[str]:
    """Features chosen among ``n_features`` so that ``FALSE_SHARE`` of them are false
    (Benjamini and Hochberg): a chance counts by its rank, so no number of documents is set."""
    ranked = sorted(surprises, key=lambda x: (-x[1], x[0]))
    last = 0
    for rank, (_, surprise) in enumerate(ranked, 1):
        if math.exp(-surprise) * n_features <= FALSE_SHARE * rank:
            last = rank
    return {feature for feature, _ in ranked[:last]}


_WINDOW = pa.schema([("words", pa.list_(pa.string())), ("tags", pa.list_(pa.int32()))])


def _kind(words: list[str]) -> int:
    """The least hash of three words in a row: mostly the same for near copies."""
    triples = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(xxhash.xxh64_intdigest(x) for x in triples) >> 1


def _calibrate(judged: list[tuple[float, int]]) -> tuple[float, float]:
    """A logistic curve through the labels over the logarithm of the evidence."""
    if not judged:
        return 0.0, 1.0
    x = np.log(FLOOR + np.array([e for e, _ in judged]))
    y = np.array([label for _, label in judged], float)
    design = np.stack([np.ones_like(x), x], axis=1)
    theta = np.zeros(2)
    for _ in range(30):  # Newton's method; the ridge keeps separable labels finite
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        theta += np.clip(np.linalg.solve(hessian, design.T @ (y - p) - 0.01 * theta), -2, 2)
    return float(theta[0]), float(max(theta[1], 0.1))


def _train(sample: list[tuple[tuple[str, ...], tuple[int, ...]]]) -> Model:
    """Maximum likelihood with an L2 penalty, by adaptive gradient steps."""
    numbers: dict[str, int] = {}
    for words, tags in sample:
        for word, tag in zip(words, tags, strict=True):
            if tag:
                for feature in features(word):
                    numbers.setdefault(feature, len(numbers))
    if not numbers:
        return Model({}, -30.0, np.zeros((2, 2)), np.zeros(2))
    longest = max(len(words) for words, _ in sample)
    n = len(sample)
    tags = np.zeros((n, longest), np.int64)
    valid = np.zeros((n, longest), bool)
    place, which = [], []
    for i, (words, own) in enumerate(sample):
        tags[i, : len(own)] = own
        valid[i, : len(own)] = True
        for t, word in enumerate(words):
            for feature in features(word):
                if feature in numbers:
                    place.append(i * longest + t)
                    which.append(numbers[feature])
    place, which = np.array(place), np.array(which)
    # Parameters: feature weights, bias, transitions (4), start (2).
    theta = np.zeros(len(numbers) + 7)
    squares = np.full(len(theta), 1e-8)
    empirical = np.zeros(len(theta))
    toxic = (tags == 1) & valid
    empirical[: len(numbers)] = np.bincount(which, weights=toxic.reshape(-1)[place], minlength=len(numbers))
    empirical[len(numbers)] = toxic.sum()
    pair = valid[:, 1:]
    empirical[-6:-2] = np.bincount((tags[:, :-1] * 2 + tags[:, 1:])[pair], minlength=4)
    empirical[-2:] = np.bincount(tags[:, 0], minlength=2)
    for _ in range(ROUNDS):
        score = np.zeros(n * longest)
        np.add.at(score, place, theta[which])
        score = score.reshape(n, longest) + theta[len(numbers)]
        node, edges = _expected(score, valid, theta[-6:-2].reshape(2, 2), theta[-2:])
        gradient = empirical - L2 * n * theta
        gradient[: len(numbers)] -= np.bincount(which, weights=node.reshape(-1)[place], minlength=len(numbers))
        gradient[len(numbers)] -= node.sum()
        gradient[-6:-2] -= edges.reshape(-1)
        gradient[-2:] -= [n - node[:, 0].sum(), node[:, 0].sum()]
        squares += gradient**2
        theta += 0.5 * gradient / np.sqrt(squares)
    weights = {f: float(theta[k]) for f, k in numbers.items()}
    return Model(weights, float(theta[len(numbers)]), theta[-6:-2].reshape(2, 2), theta[-2:])


def _expected(score: np.ndarray, valid: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Forward-backward over all windows at once: marginals of "toxic", and expected pairs."""
    n, longest = score.shape
    emission = np.exp(np.stack([np.zeros_like(score), np.clip(score, -50, 50)], axis=2))
    step = np.exp(transitions)
    forward = np.zeros((n, longest, 2))
    forward[:, 0] = np.exp(start) * emission[:, 0]
    forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        moved = forward[:, t - 1] @ step * emission[:, t]
        forward[:, t] = np.where(valid[:, t, None], moved / moved.sum(axis=1, keepdims=True), forward[:, t - 1])
    backward = np.ones((n, longest, 2))
    edges = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        behind = emission[:, t + 1] * backward[:, t + 1]
        joint = forward[:, t, :, None] * step * behind[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        edges += joint[valid[:, t + 1]].sum(axis=0)
        moved = behind @ step.T
        backward[:, t] = np.where(valid[:, t + 1, None], moved / moved.sum(axis=1, keepdims=True), 1.0)
    node = forward * backward
    node = node[:, :, 1] / node.sum(axis=2)
    return np.where(valid, node, 0.0), edges


class Tagger:
    """Marginals of a text's tokens under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}
        self.step = np.exp(model.transitions)
        self.start = np.exp(model.start - model.start.max())
        plain = self.step * np.exp([0.0, model.bias])
        self.values, vectors = np.linalg.eig(plain)
        self.values = self.values.real / self.values.real.max()
        self.vectors, self.inverse = vectors.real, np.linalg.inv(vectors).real
        self.plain = plain

    def weight(self, word: str) -> float:
        """What the features of a word add to the bias; 0 for a word like any other."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_TOKENS:
                self.known.clear()
            weights = self.model.weights
            found = self.known[word] = sum(weights.get(f, 0.0) for f in features(word))
        return found

    def informative(self, words: list[str]) -> list[int]:
        known, weight = self.known, self.weight
        return [i for i, w in enumerate(words) if (known[w] if w in known else weight(w)) != 0.0]

    def judge(self, words: list[str]) -> tuple[list[int], list[float], float, float]:
        """Informative places, their marginals, the document's evidence and its score.

        Evidence is that of independent causes, each distinct word counting once: the
        negative logarithm of the chance that none of them is toxic.
        """
        at = self.informative(words)
        if not at:
            return at, [], 0.0, self.scale(0.0)
        marginals = self.marginals(words, at)
        most: dict[str, float] = {}
        for i, p in zip(at, marginals, strict=True):
            most[words[i]] = max(p, most.get(words[i], 0.0))
        evidence = -sum(math.log(max(1 - p, LEAST_DOUBT)) for p in most.values())
        return at, marginals, evidence, self.scale(evidence)

    def scale(self, evidence: float) -> float:
        base, slope = self.model.calibration
        if not self.model.weights:
            return 0.0
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, base + slope * math.log(FLOOR + evidence)))))

    def _run(self, length: int) -> np.ndarray:
        """``length`` steps over tokens without features, up to a factor."""
        if length == 0:
            return np.eye(2)
        return np.maximum(self.vectors * self.values**length @ self.inverse, 0.0)

    def marginals(self, words: list[str], at: list[int]) -> list[float]:
        """The probability of "toxic" at each of the informative places ``at``."""
        emission = [np.exp([0.0, min(50.0, self.model.bias + self.weight(words[i]))]) for i in at]
        # Up to the token before each place, beginning with the start potentials.
        forward, vector, last = [], None, -1
        for k, i in enumerate(at):
            if vector is None:
                if i == 0:
                    vector = self.start * emission[0]
                else:
                    first = self.start * np.exp([0.0, self.model.bias])
                    vector = first @ self._run(i - 1) @ self.step * emission[k]
            else:
                vector = vector @ self._run(i - last - 1) @ self.step * emission[k]
            vector = vector / vector.sum()
            forward.append(vector)
            last = i
        out = [0.0] * len(at)
        vector, after = np.ones(2), len(words)
        for k in range(len(at) - 1, -1, -1):
            i = at[k]
            if after == len(words):
                vector = self._run(len(words) - 1 - i) @ np.ones(2)
            else:
                vector = self._run(after - i - 1) @ self.step @ (emission[k + 1] * vector)
            vector = vector / vector.sum()
            joint = forward[k] * vector
            out[k] = float(joint[1] / joint.sum())
            after = i
        return out


def score(
    docs: DataFrame,
    model: Model,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Toxicity of every row, from the marginals of its tokens, and the offending spans.

    ``spans`` are code point offsets of tokens whose marginal is at least 0.5. A null or
    empty text, or one without an informative token, has the least score; without any
    toxic and clean document to learn from every score is 0. ``held_out`` tells rows whose labels
    were not learnt. One row per input row; repeated and null ids are carried
    through, other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            scores, spans = [], []
            for content in batch.column("text"):
                content = content.as_py()
                at, marginals, _, value = tagger.judge(_words(content))
                scores.append(value)
                spans.append(_spans(content, dict(zip(at, marginals, strict=True))) if at else [])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "score": pa.array(scores, pa.float64()),
                    "predicted": pa.array([int(x >= threshold) for x in scores], pa.int32()),
                    "spans": pa.array(spans, _SPANS),
                }
            )

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns and without a shuffle."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        tagger = Tagger(model)
        return pd.Series([tagger.judge(_words(x))[3] < threshold for x in texts], dtype=bool)

    return docs.filter(clean(F.coalesce(F.col(text).cast("string"), F.lit(""))))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))


def _spans(text: str, marginals: dict[int, float]) -> list[dict]:
    if max(marginals.values()) < OFFENDING:
        return []
    # Lowering can lengthen a text, so places come from the text as it is.
    place, out = 0, []
    for match in TOKEN.finditer(text):
        for _ in TOKEN.findall(match[0].lower()):
            if marginals.get(place, 0.0) >= OFFENDING:
                out.append({"start": match.start(), "end": match.end(), "marginal": marginals[place]})
            place += 1
    return out
