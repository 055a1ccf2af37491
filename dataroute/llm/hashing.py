"""Hashes of words, windows and byte strings, for whole arrays at a time.

A string's hash is a polynomial over one random 64-bit value per byte, read off running
sums, so that all words (or all windows) of a text cost a few passes over it. Values are
mixed at the end: their high bits choose buckets and their order is a random one.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
#: Bytes hashed at once: running sums and powers of this length stay in the cache.
SEGMENT = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all others (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _seeded(seed: int) -> tuple[np.ndarray, int, int]:
    random = np.random.Generator(np.random.PCG64(seed))
    base = int(random.integers(1 << 62, dtype=np.uint64)) << 3 | 5
    base &= (1 << 64) - 1
    return random.integers(1 << 63, size=256, dtype=np.uint64) * U(2) + U(1), base, pow(base, -1, 1 << 64)


@cache
def _powers(seed: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    _, base, inverse = _seeded(seed)

    def powers(x: int) -> np.ndarray:
        out = np.full(length, U(x))
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(base), powers(inverse)


def powers(seed: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's base and of its inverse; at least ``length`` of them."""
    return _powers(seed, 1 << max(10, int(length).bit_length()))


def byte_values(data: np.ndarray, seed: int) -> np.ndarray:
    """The seed's random value of each byte."""
    return _seeded(seed)[0][data]


def running(values: np.ndarray, seed: int) -> np.ndarray:
    """Running polynomial sums: entry ``i`` is the sum over ``values[:i]``."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(seed, len(values))[0][: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the stretches ``start:end``, the same wherever a stretch lies."""
    return (sums[end] - sums[start]) * powers(seed, len(sums))[1][start]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of ``data``: bytes other than ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of each word; segments of words are hashed one after another."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SEGMENT, "right")))
        low, high = int(start[at]), int(end[to - 1])
        s, e = start[at:to] - low, end[at:to] - low
        sums = running(byte_values(data[low:high], seed), seed)
        out[at:to] = between(sums, s, e, seed) + (e - s).astype(U)
        at = to
    return mix(out)


def windows(hashes: np.ndarray, at: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """Hashes of the ``size`` consecutive word hashes from each place ``at``."""
    base = U(_seeded(seed)[1])
    out = hashes[at].copy()
    for k in range(1, size):
        out *= base
        out += hashes[at + k]
    return mix(out)


def texts_as_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a blank behind each, and where each begins (and the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.concatenate([[0], np.cumsum(sizes)])


def words_of(texts: list[bytes], seeds: tuple[int, ...] = (1,), lower: bool = False):
    """``(hashes of each seed, first word of each text and the end)`` for many texts."""
    data, begins = texts_as_bytes(texts)
    if lower:
        data = LOWER[data]
    start, end = word_spans(data)
    first = np.searchsorted(start, begins)
    return [word_hashes(data, start, end, seed) for seed in seeds], first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each begins in sorted order, and that order."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.empty(0, np.int64)
    return ranked[begins], begins, order
