"""Removal of repeated byte strings by suffix arrays of the passages that repeat.

A suffix array of a whole corpus fits no machine. A string of 100 bytes can only repeat if
its least 32-byte gram (by hash), its anchor, does, and equal strings have equal anchors.
So the strings of the corpus are dealt out by their anchors, each to one place:

1. Blocks of documents ask which anchors occur more than once.
2. Around such an anchor the strings that have it are one passage of a document. Equal
   passages of a block are sent once, with their first place. A bucket puts its distinct
   passages together in texts of bounded length and builds their suffix arrays (by linear
   grouping, see ``suffix_array``). Neighbours in such an array that agree in 100 bytes
   are equal strings, and the first place of each string stays.
3. Bytes under any other string go.

Before a suffix array is built, strings whose 64-bit hash no other string of the bucket
has are left out of its text: nothing can equal them. Equality is always decided by the
bytes. A passage that a third of all documents hold reaches its bucket once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from dataroute.llm import blocks as B
from dataroute.llm import hashing as H
from dataroute.llm.suffix_array import suffix_array

#: Bytes of a string that counts as repeated, and of an anchor.
LENGTH, GRAM = 100, 32
#: Bytes that a suffix array is built of at once.
TEXT_BYTES = 1 << 17
#: Windows that are looked at together; a longer document is taken in pieces.
PIECE = 1 << 18

SCHEMA = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
    "spans array<struct<start: long, end: long>>"
)


def remove_repeated_strings(
    docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Bytes that are left when strings that start earlier too are removed.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes of its document
    covers it that also starts earlier: in a document with a smaller id, or before in the
    same one, overlaps included. Strings are judged on the input. Returns ``doc_id``,
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (the bytes
    that stay) and ``spans`` (the runs, end exclusive), one row per input row.

    A null text is empty. A null id counts as larger than all others. Rows with equal ids
    are one document, in which equal places are not before each other: a repeated row
    stays as whole as the first. Other columns are not read. ``length`` must be larger
    than the anchor's 32 bytes.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM} bytes")
    n = B.block_count(docs, text)
    dealt = B.frames(docs, n, doc_id, text)
    repeated = B.answer(
        B.ask(dealt, n, lambda table: _ask_anchors(_Block(table, length), n)), n, B.reply_shared
    )
    judged = B.answer(
        B.ask_again(dealt, repeated, n, lambda table, got: _ask_passages(_Block(table, length), got, n)),
        n,
        lambda payloads: _judge(payloads, length),
    )
    answers = B.both(repeated, judged, n)
    return B.finish(dealt, answers, lambda table, got: _kept(_Block(table, length), got, n), SCHEMA)


class _Block:
    """The documents of a block, and the runs of their strings that have one anchor."""

    def __init__(self, table: pa.Table, length: int):
        self.length, self.ids, self.texts = length, [], []
        for ids, texts in B.documents(table):
            self.ids.append(ids)
            self.texts += texts
        self.ids = np.concatenate(self.ids)

    def _pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes taken together, and for each of them its document and its place there."""
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for k, text in enumerate(self.texts):
            # A piece has all strings that start in it whole.
            for low in range(0, max(1, len(text) - self.length + 1), PIECE):
                part = text[low : low + PIECE + self.length - 1]
                if len(part) < self.length:
                    continue
                held.append((k, low, part))
                size += len(part)
                if size >= PIECE:
                    yield self._joined(held)
                    held, size = [], 0
        if held:
            yield self._joined(held)

    @staticmethod
    def _joined(held: list[tuple[int, int, bytes]]):
        sizes = [len(part) for _, _, part in held]
        data = np.frombuffer(b"".join(part for _, _, part in held), np.uint8)
        doc = np.repeat([k for k, _, _ in held], sizes)
        place = np.arange(len(data)) + np.repeat(
            [low for _, low, _ in held] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes
        )
        return data, doc, place

    def _anchored(self):
        """Hashes of the grams, and of the anchor of each string (0 where none starts)."""
        span = self.length - GRAM + 1
        for data, doc, place in self._pieces():
            sums = H.running(H.byte_values(data, 3), 3)
            at = np.arange(len(data) - GRAM + 1)
            grams = H.mix(H.between(sums, at, at + GRAM, 3)) | H.U(1)
            least = _sliding(np.minimum, grams, span)
            least[doc[: len(least)] != doc[self.length - 1 :]] = 0
            # Two pieces of one document can be neighbours; no string goes across them.
            least[place[self.length - 1 :] - place[: len(least)] != self.length - 1] = 0
            yield grams, least, doc, place

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, sorted, and whether each is at several places of the block."""
        found = []
        for grams, least, _, _ in self._anchored():
            span = self.length - GRAM + 1
            padded = np.concatenate([np.zeros(span - 1, H.U), least, np.zeros(span - 1, H.U)])
            found.append(grams[grams == _sliding(np.maximum, padded, span)[: len(grams)]])
        keys = _spread(np.concatenate([np.zeros(0, H.U), *found]))
        ranked, begins, _ = H.distinct(keys)
        return ranked, np.diff(np.r_[begins, len(keys)]) > 1

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of strings with one anchor: anchor, document, first place, number."""
        out = []
        for _, least, doc, place in self._anchored():
            apart = (least[1:] != least[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1])
            begins = np.flatnonzero(np.r_[True, apart])
            count = np.diff(np.r_[begins, len(least)])
            some = least[begins] != 0
            begins, count = begins[some], count[some]
            out.append((_spread(least[begins]), doc[begins], place[begins], count))
        if not out:
            return np.zeros(0, H.U), *[np.zeros(0, np.int64)] * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def passages(self, answers: dict[int, bytes], n: int):
        """Runs with a repeated anchor, the passage of each, and the first place of each passage.

        Passages are distinct pairs of an anchor and bytes, sorted by anchor.
        """
        anchor, doc, place, count = self.runs()
        ranked = H.distinct(anchor)[0]
        repeated = B.read_shared(answers, ranked, n)[np.searchsorted(ranked, anchor)]
        anchor, doc, place, count = (x[repeated] for x in (anchor, doc, place, count))
        first: dict[tuple[int, bytes], tuple[int, int]] = {}
        keys = []
        ids = self.ids[doc].tolist()
        for value, k, low, many, number in zip(
            anchor.tolist(), doc.tolist(), place.tolist(), count.tolist(), ids, strict=True
        ):
            key = (value, self.texts[k][low : low + many + self.length - 1])
            keys.append(key)
            here = (number, low)
            if first.setdefault(key, here) > here:
                first[key] = here
        order = sorted(first)
        rank = {key: k for k, key in enumerate(order)}
        which = np.fromiter(map(rank.__getitem__, keys), np.int64, len(keys))
        firsts = np.array([first[x] for x in order], np.int64).reshape(-1, 2)
        return doc, place, count, which, order, firsts


def _spread(anchors: np.ndarray) -> np.ndarray:
    """Anchors are least values, so mostly small; buckets need them evenly spread."""
    return H.mix(anchors ^ H.U(0xD6E8FEB86659FD93))


def _sliding(pick: np.ufunc, values: np.ndarray, span: int) -> np.ndarray:
    """The least or greatest of every ``span`` values in a row, by doubling."""
    out, width = values.copy(), 1
    while 2 * width <= span:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(out) - (span - width)], out[span - width :]) if width < span else out


def _ask_anchors(block: _Block, n: int):
    ranked, multiple = block.anchors()
    yield from B.ask_shared(ranked, multiple, n)


def _ask_passages(block: _Block, answers: dict[int, bytes], n: int):
    _, _, _, _, order, firsts = block.passages(answers, n)
    packer = zstandard.ZstdCompressor(level=3)
    keys = np.array([x for x, _ in order], H.U)
    for bucket, part in B.slices(keys, n):
        own = [x for _, x in order[part]]
        sizes = np.array([len(x) for x in own], "<i8")
        head = np.concatenate([[len(own)], sizes, firsts[part, 0], firsts[part, 1], keys[part].view(np.int64)])
        yield bucket, packer.compress(head.astype("<i8").tobytes() + b"".join(own))


def _judge(payloads: list[bytes], length: int) -> list[bytes]:
    """For every asked passage, which of its strings start earlier somewhere.

    One byte per passage: 0 none, 1 all, 2 as the bits that follow say.
    """
    number: dict[tuple[int, bytes], int] = {}
    passages, asked = [], []
    firsts: list[tuple[int, int]] = []
    for payload in payloads:
        data = zstandard.decompress(payload)
        count = int(np.frombuffer(data[:8], "<i8")[0])
        sizes, ids, places, keys = np.frombuffer(data[8 : 8 + 32 * count], "<i8").reshape(4, count).tolist()
        at = 8 + 32 * count
        own = []
        for size, doc, place, key in zip(sizes, ids, places, keys, strict=True):
            entry = (key, data[at : at + size])
            at += size
            k = number.setdefault(entry, len(passages))
            if k == len(passages):
                passages.append(entry)
                firsts.append((doc, place))
            elif (doc, place) < firsts[k]:
                firsts[k] = (doc, place)
            own.append((k, (doc, place)))
        asked.append(own)
    marks = _earlier(passages, np.array(firsts, np.int64), length)
    out = []
    for own in asked:
        states = bytearray()
        flags = []
        for k, here in own:
            if here != firsts[k]:
                states.append(1)
            elif k in marks:
                states.append(2)
                flags.append(marks[k])
            else:
                states.append(0)
        out.append(bytes(states) + B.bits(np.concatenate([np.zeros(0, bool), *flags])))
    return out


def _earlier(passages: list[tuple[int, bytes]], firsts: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Of passages with a string that equals another one: which strings start earlier."""
    count = np.array([len(x) - length + 1 for _, x in passages])
    owner = np.repeat(np.arange(len(passages)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    hashes = np.concatenate([_string_hashes(part, length) for part in _batches(passages)])
    ranked, begins, order = H.distinct(hashes)
    many = np.empty(len(hashes), bool)
    many[order] = np.repeat(np.diff(np.r_[begins, len(order)]) > 1, np.diff(np.r_[begins, len(order)]))
    some = np.flatnonzero(many)
    if not len(some):
        return {}
    owner, place, hashes = owner[some], place[some], hashes[some]
    anchor = np.array([x for x, _ in passages], np.int64)[owner]
    classes = _classes(passages, owner, place, anchor, hashes, length)
    doc, at = firsts[owner, 0], firsts[owner, 1] + place
    order = np.lexsort((at, doc, classes))
    begins = np.flatnonzero(np.r_[True, np.diff(classes[order]) != 0])
    lead = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))
    later = np.empty(len(order), bool)
    later[order] = (doc[order] != doc[lead]) | (at[order] != at[lead])
    out = {}
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
        if later[part].any():
            marks = out[int(owner[part[0]])] = np.zeros(int(count[owner[part[0]]]), bool)
            marks[place[part]] = later[part]
    return out


def _batches(passages: list[tuple[int, bytes]]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for _, text in passages:
        held.append(text)
        size += len(text)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _string_hashes(texts: list[bytes], length: int) -> np.ndarray:
    data = np.frombuffer(b"".join(texts), np.uint8)
    sums = H.running(H.byte_values(data, 5), 5)
    sizes = np.array([len(x) for x in texts])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    at = np.flatnonzero(room >= length)
    return H.mix(H.between(sums, at, at + length, 5))


def _classes(passages, owner, place, anchor, hashes, length: int) -> np.ndarray:
    """A number per string, the same for equal ones, from suffix arrays of their passages.

    Strings of one anchor stand in one text. Where these are longer than a text may be
    they are told apart by ranges of their hash first: equal strings have equal hashes.
    """
    group = np.unique(anchor, return_inverse=True)[1]
    pieces = _cut(passages, owner, place, group, length)
    volume = np.zeros(int(group.max()) + 1, np.int64)
    for own, text in pieces:
        volume[own] += len(text)
    ranges = -(-volume // TEXT_BYTES)
    if (ranges > 1).any():
        share = ((hashes >> H.U(32)) * ranges[group].astype(H.U)) >> H.U(32)
        group = (np.cumsum(ranges) - ranges)[group] + share.astype(np.int64)
        pieces = _cut(passages, owner, place, group, length)
    classes = np.empty(len(owner), np.int64)
    total = 0
    held: list[tuple[bytes, list[int]]] = []
    size, last = 0, -1
    for (own, text), starts in sorted(pieces.items()):
        if held and own != last and size + len(text) > TEXT_BYTES:
            total = _by_suffixes(held, length, classes, total)
            held, size = [], 0
        held.append((text, starts))
        size += len(text)
        last = own
    _by_suffixes(held, length, classes, total)
    return classes


def _cut(passages, owner, place, group, length: int) -> dict[tuple[int, bytes], list[int]]:
    """Distinct stretches of neighbouring strings of one group, and where each begins."""
    apart = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (group[1:] != group[:-1])
    begins = np.flatnonzero(np.r_[True, apart])
    ends = np.r_[begins[1:], len(owner)]
    out: dict[tuple[int, bytes], list[int]] = {}
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        low = int(place[begin])
        text = passages[owner[begin]][1][low : low + end - begin + length - 1]
        out.setdefault((int(group[begin]), text), []).append(begin)
    return out


def _by_suffixes(held: list[tuple[bytes, list[int]]], length: int, classes: np.ndarray, total: int) -> int:
    """Number the strings of some stretches by their rank in a suffix array; the next number."""
    sizes = np.array([len(text) for text, _ in held])
    # 1 stands between stretches and 0 at the end; bytes are above both.
    symbols = np.frombuffer(b"\n".join([*(text for text, _ in held), b""]), np.uint8).astype(np.int64) + 2
    edges = np.cumsum(sizes + 1) - 1
    symbols[edges] = 1
    symbols = np.append(symbols, 0)
    starts = np.concatenate([[0], edges[:-1] + 1])
    whole = np.zeros(len(symbols), bool)
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        whole[start : start + size - length + 1] = True
    order = suffix_array(symbols)
    order = order[whole[order]]
    # Neighbours are equal strings if they agree in all their symbols.
    new = np.ones(len(order), bool)
    strings = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.uint16), length)
    for low in range(1, len(order), 1 << 14):
        part = order[low - 1 : low + (1 << 14)]
        seen = strings[part]
        new[low : low + (1 << 14)] = (seen[1:] != seen[:-1]).any(axis=1)
    rank = np.empty(len(symbols), np.int64)
    rank[order] = total + np.cumsum(new) - 1
    for start, size, (_, begins) in zip(starts.tolist(), sizes.tolist(), held, strict=True):
        many = size - length + 1
        for begin in begins:
            classes[begin : begin + many] = rank[start : start + many]
    return total + int(new.sum())


def _kept(block: _Block, answers: dict[int, bytes], n: int) -> pa.Table:
    doc, place, count, which, order, firsts = block.passages({k: v for k, v in answers.items() if k < n}, n)
    keys = np.array([x for x, _ in order], H.U)
    many = np.array([len(x) - block.length + 1 for _, x in order], np.int64)
    gone: dict[int, list[tuple[int, np.ndarray | None]]] = {}
    state = np.zeros(len(order), np.uint8)
    marks: dict[int, np.ndarray] = {}
    for bucket, part in B.slices(keys, n):
        data = bytes(answers[bucket + n])
        size = part.stop - part.start
        state[part] = np.frombuffer(data[:size], np.uint8)
        marked = part.start + np.flatnonzero(state[part] == 2)
        ends = np.cumsum(many[marked])
        flags = B.unbits(data[size:], int(many[marked].sum()))
        for k, end in zip(marked.tolist(), ends.tolist(), strict=True):
            marks[k] = flags[end - many[k] : end]
    first = (block.ids[doc] == firsts[which, 0]) & (place == firsts[which, 1])
    for k in np.flatnonzero(~first | (state[which] > 0)).tolist():
        own = marks.get(int(which[k])) if first[k] and state[which[k]] == 2 else None
        gone.setdefault(int(doc[k]), []).append((k, own))
    columns = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept", "spans")}
    for k, text in enumerate(block.texts):
        spans = []
        if k in gone:
            edge = np.zeros(len(text) + 1, np.int32)
            for run, own in gone[k]:
                low, size = int(place[run]), int(count[run])
                if own is None:
                    edge[low] += 1
                    edge[low + size + block.length - 1] -= 1
                else:
                    at = low + np.flatnonzero(own)
                    edge[at] += 1
                    edge[at + block.length] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            step = np.diff(np.r_[0, covered.astype(np.int8), 0])
            spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
        at, left = 0, []
        for start, end in spans:
            left.append(text[at:start])
            at = end
        left.append(text[at:])
        kept = b"".join(left)
        columns["n_bytes"].append(len(text))
        columns["n_removed"].append(len(text) - len(kept))
        columns["n_spans"].append(len(spans))
        columns["kept"].append(kept)
        columns["spans"].append([{"start": a, "end": b} for a, b in spans])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(span)]
    return pa.table(
        {"doc_id": B.ids_out(block.ids)}
        | {name: pa.array(values, kind) for (name, values), kind in zip(columns.items(), types, strict=True)}
    )
