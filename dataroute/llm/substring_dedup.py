"""Removal of passages of words that an earlier document has (difference-cover anchors).

Any two equal stretches of ``window`` words lie at some places ``i`` and ``j`` of their
documents. With a difference cover ``D`` of the period 7 there is an offset below 7 that
takes both places into ``D`` modulo 7, so it is enough to hash windows of ``window - 6``
words at the three places in seven that ``D`` names: equal stretches share such an anchor
at the same offset. Three passes over blocks of documents follow from that.

1. Anchors: each block asks which of its anchors another document has.
2. Extension: stretches of ``window`` words around a shared anchor are hashed in full (96
   bits) and each block asks whether a document with a smaller id has the same stretch.
3. Words covered by such stretches go.

What crosses the network is 5 bytes per distinct anchor of a block, 20 bytes (before
compression) per distinct candidate stretch of a block, and one bit back for each.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from dataroute.llm import blocks as B
from dataroute.llm import hashing as H

PERIOD = 7
#: Every difference modulo 7 is one of two members.
COVER = (0, 1, 3)
#: Words in a stretch that counts as repeated.
WINDOW = 13

SCHEMA = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: int, end: int>>"


def remove_repeated_passages(
    docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Words that are left when passages which an earlier document has are removed.

    Words are runs of bytes other than ASCII white space, compared as they are. A word
    goes if a stretch of ``window`` words of its document covers it and the same stretch
    also starts in a document with a smaller id; stretches are judged on the input.
    Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined
    by one blank) and ``spans`` (removed runs as word positions, end exclusive), one row
    per input row.

    A null text has no words. A null id counts as larger than all others. Rows with equal
    ids, repeated rows among them, are one document here: neither is earlier than the
    other. Other columns are not read. Any window of at least ``PERIOD`` words will do.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    n = B.block_count(docs, text)
    dealt = B.frames(docs, n, doc_id, text)
    anchored = B.answer(
        B.ask(dealt, n, lambda table: _ask_anchors(_Words(table, window), n)), n, B.reply_shared
    )
    compared = B.answer(
        B.ask_again(dealt, anchored, n, lambda table, got: _ask_stretches(_Words(table, window), got, n)),
        n,
        _reply_earlier,
    )
    # The last pass needs both answers: which stretches were asked about, and the reply.
    answers = B.both(anchored, compared, n)
    return B.finish(dealt, answers, lambda table, got: _kept(_Words(table, window), got, n), SCHEMA)


class _Words:
    """The words of a block, one document after another."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.ids, self.texts = window, [], []
        hashes, sizes = [], []
        for ids, texts in B.documents(table):
            (found,), first = H.words_of(texts)
            hashes.append(found)
            sizes.append(np.diff(first))
            self.ids.append(ids)
            self.texts += texts
        self.ids = np.concatenate(self.ids)
        self.sizes = np.concatenate(sizes)
        self.hashes = np.concatenate(hashes)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.place = np.arange(len(self.hashes)) - self.first[self.doc]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the anchors and their hashes."""
        size = self.window - PERIOD + 1
        room = self.sizes[self.doc]
        at = np.flatnonzero(
            np.isin(self.place % PERIOD, COVER) & (self.place + size <= room) & (room >= self.window)
        )
        return at, H.windows(self.hashes, at, size)

    def candidates(self, answers: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of stretches around shared anchors, and two hashes of each."""
        at, keys = self.anchors()
        ranked, begins, order = H.distinct(keys)
        shared = np.empty(len(at), bool)
        shared[order] = np.repeat(
            B.read_shared(answers, ranked, n), np.diff(np.r_[begins, len(order)])
        )
        at = at[shared]
        # An anchor counts for the stretches that begin at most PERIOD - 1 words before it.
        edge = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(edge, np.maximum(at - PERIOD + 1, self.first[self.doc[at]]), 1)
        np.add.at(edge, at + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        starts = np.flatnonzero(near & (self.place + self.window <= self.sizes[self.doc]))
        second = H.mix(self.hashes ^ H.U(0xA0761D6478BD642F))
        return starts, H.windows(self.hashes, starts, self.window), H.windows(second, starts, self.window, 13)


def _ask_anchors(words: _Words, n: int):
    at, keys = words.anchors()
    ranked, begins, order = H.distinct(keys)
    if not len(ranked):
        return
    ids = words.ids[words.doc[at]][order]
    several = np.minimum.reduceat(ids, begins) != np.maximum.reduceat(ids, begins)
    yield from B.ask_shared(ranked, several, n)


def _stretches(words: _Words, answers: dict[int, bytes], n: int):
    """Candidate places with the group of each, and of the groups both hashes and the least id."""
    starts, one, two = words.candidates(answers, n)
    two = two & H.U(0xFFFFFFFF)
    order = np.lexsort((two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])][: len(order)]
    begins = np.flatnonzero(new)
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(new) - 1
    ids = words.ids[words.doc[starts]]
    least = np.minimum.reduceat(ids[order], begins) if len(begins) else np.empty(0, np.int64)
    return starts, ids, group, one[order][begins], two[order][begins], least


def _ask_stretches(words: _Words, answers: dict[int, bytes], n: int):
    _, _, _, one, two, least = _stretches(words, answers, n)
    packer = zstandard.ZstdCompressor(level=1)
    for bucket, part in B.slices(one, n):
        head = np.array([part.stop - part.start], "<i8").tobytes()
        body = one[part].astype("<u8").tobytes() + two[part].astype("<u4").tobytes()
        yield bucket, head + body + packer.compress(least[part].astype("<i8").tobytes())


def _reply_earlier(payloads: list[bytes]) -> list[bytes]:
    """One bit per stretch: a document with a smaller id than the asker's least has it."""
    one, two, least, sizes = [], [], [], []
    for payload in payloads:
        size = int(np.frombuffer(payload[:8], "<i8")[0])
        one.append(np.frombuffer(payload[8 : 8 + 8 * size], "<u8"))
        two.append(np.frombuffer(payload[8 + 8 * size : 8 + 12 * size], "<u4"))
        least.append(np.frombuffer(zstandard.decompress(payload[8 + 12 * size :]), "<i8"))
        sizes.append(size)
    one, two, least = np.concatenate(one), np.concatenate(two), np.concatenate(least)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    begins = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.minimum.reduceat(least[order], begins)
    earlier = np.empty(len(one), bool)
    earlier[order] = np.repeat(first, np.diff(np.r_[begins, len(order)])) < least[order]
    return [B.bits(x) for x in np.split(earlier, np.cumsum(sizes)[:-1])]


def _kept(words: _Words, answers: dict[int, bytes], n: int) -> pa.Table:
    asked = {k: v for k, v in answers.items() if k < n}
    starts, ids, group, one, _, least = _stretches(words, asked, n)
    earlier = B.read_shared({k - n: v for k, v in answers.items() if k >= n}, one, n)
    starts = starts[earlier[group] | (ids > least[group])] if len(starts) else starts
    edge = np.zeros(len(words.hashes) + 1, np.int32)
    edge[starts] += 1
    np.add.at(edge, starts + words.window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
    kept, spans = [], []
    for k, text in enumerate(words.texts):
        found = text.split()
        if n_removed[k]:
            mask = gone[words.first[k] : words.first[k + 1]]
            found = list(compress(found, ~mask))
            step = np.diff(np.r_[0, mask.astype(np.int8), 0])
            spans.append(
                [
                    {"start": s, "end": e}
                    for s, e in zip(
                        np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True
                    )
                ]
            )
        else:
            spans.append([])
        kept.append(b" ".join(found))
    return pa.table(
        {
            "doc_id": B.ids_out(words.ids),
            "n_words": pa.array(words.sizes, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "spans": pa.array(
                spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            ),
        }
    )
