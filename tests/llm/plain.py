"""Plain single-machine versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def order(doc_id) -> tuple:
    """Null ids come last."""
    return (doc_id is None, doc_id or 0)


def copy_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((doc_id, keep, len(own), doc_id == keep, sha((text or "").encode())))
    return out


def without_strings(rows, length=100):
    """Rows of distinct ids."""
    first: dict[bytes, tuple] = {}
    texts = {doc_id: (text or "").encode() for doc_id, text in rows}
    for doc_id in sorted(texts, key=order):
        data = texts[doc_id]
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], (doc_id, k))
    out = []
    for doc_id, data in texts.items():
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] != (doc_id, k):
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, y in zip(data, gone) if not y)
        out.append((doc_id, len(data), len(data) - len(kept), runs, sha(kept)))
    return out


def shingles(text, words):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1))


def near_duplicates(rows, words, percent):
    """Rows with equal ids are one document with several sets."""
    sets = [shingles(text, words) for _, text in rows]
    parent: dict = {doc_id: doc_id for doc_id, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        common = Counter(j for token in own for j in holders[token])
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])), key=order)
                parent[b] = a
        for token in own:
            holders[token].append(i)
    return [(doc_id, len(own), root(doc_id)) for (doc_id, _), own in zip(rows, sets)]


def tokens(rows, tokenizer):
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())))
    return out


def pieces(rows, tokenizer, capacity=2048):
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        start, edge, piece = 0, len(ids) % capacity or capacity, 0
        while start < len(ids):
            own = ids[start:edge]
            out.append((doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
            start, edge, piece = edge, edge + capacity, piece + 1
    return out


def without_passages(rows, window=13):
    """Rows with equal ids are one document."""
    least: dict[tuple, tuple] = {}
    for doc_id, text in rows:
        found = (text or "").encode().split()
        for k in range(len(found) - window + 1):
            key = tuple(found[k : k + window])
            least[key] = min(order(doc_id), least.get(key, order(doc_id)))
    out = []
    for doc_id, text in rows:
        found = (text or "").encode().split()
        gone = [False] * len(found)
        for k in range(len(found) - window + 1):
            if least[tuple(found[k : k + window])] < order(doc_id):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, y in zip(found, gone) if not y)
        out.append((doc_id, len(found), sum(gone), sha(kept)))
    return out


def search(rows, is_query, k):
    """Every row but the query's own is a candidate, rows that repeat an id too."""
    out = []
    for n, (q, x) in enumerate(rows):
        if q is None or not is_query(q):
            continue
        best = sorted(
            (-sum(a * b for a, b in zip(x, y)), order(i)) for m, (i, y) in enumerate(rows) if m != n
        )
        out += [(q, r + 1, None if none else i, -s) for r, (s, (none, i)) in enumerate(best[:k])]
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {x: x + 32 for x in range(ord("A"), ord("Z") + 1)}


def lexical(docs, items, k):
    terms = [Counter(TERM.findall((x or "").translate(LOWER))) for _, x in docs]
    n = sum(1 for x in terms if x)
    total = sum(x.total() for x in terms)
    df = Counter(t for x in terms for t in x)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, _), own in zip(docs, terms):
            m = 100 - 90 + (90 * own.total() * n) // total if total else 0
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))) & own.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * own[t]) // (1000 * own[t] + 8 * m))
            if score > 0:
                found.append((-score, order(doc_id)))
        out += [(item_id, r + 1, None if none else i, -s) for r, (s, (none, i)) in enumerate(sorted(found)[:k])]
    return out


def negatives(rows, is_anchor, positives, wanted, low, high):
    """Rows are (id, label, vector of integers)."""
    out = []
    for n, (anchor, label, x) in enumerate(rows):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(x, y)), order(i), other)
            for m, (i, other, y) in enumerate(rows) if m != n
        )
        for s, (none, i), _ in [r for r in scored if r[2] == label][:positives]:
            near = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:wanted]
            out += [
                (anchor, None if none else i, k + 1, None if absent else j, -s, -t)
                for k, (t, (absent, j), _) in enumerate(near)
            ]
    return out
