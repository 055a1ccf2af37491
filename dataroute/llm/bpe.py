"""BPE encoding and decoding through a table of distinct words.

Text is cut into words at ASCII white space, which no token of the vocabulary crosses.
Blocks of documents ask for the distinct words they hold; a word goes to one bucket,
where it is encoded once for the whole corpus, and its ids come back to each block that
asked, in the order in which it asked. There the ids are put at every position of the
word. Decoding looks every id up in the table of pieces, whose size is the vocabulary's.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from dataroute.llm import blocks as B

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


@cache
def _tokenizer(definition: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def read_definition(path: str) -> str:
    """A tokenizer file's content; tasks get it with their function, not from a path."""
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    settings = json.loads(definition)
    if not (settings["model"].get("end_of_word_suffix") and settings.get("decoder") is None):
        raise ValueError("words are encoded one by one: the vocabulary must mark their ends")
    return definition


@cache
def _pieces(definition: str) -> list[bytes]:
    """The piece of each id, special tokens included."""
    vocabulary = _tokenizer(definition).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        out[number] = piece.encode()
    return out


def encode_documents(
    docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded``, one row per input row.

    ``ids`` are little-endian unsigned 32-bit integers, as the tokenizers library gives
    them for the whole text without special tokens added; special tokens that the text
    spells out are recognised. ``decoded`` is its decoding with special tokens kept:
    pieces joined by one blank.

    A null or empty text has no ids and decodes to an empty text. Null and repeated
    doc_ids are carried through; other columns are not read.
    """
    n = B.block_count(docs, text)
    dealt = B.frames(docs, n, doc_id, text)
    encoded = B.answer(
        B.ask(dealt, n, lambda table: _ask_words(table, n)), n, lambda got: _encode(got, definition)
    )
    return B.finish(dealt, encoded, lambda table, got: _assemble(table, got, n, definition), SCHEMA)


def _words(table: pa.Table, n: int) -> list[tuple[int, list[bytes]]]:
    """The distinct words of a block by bucket, in a fixed order."""
    found = set()
    for _, texts in B.documents(table):
        for text in texts:
            found.update(text.split())
    words: dict[int, list[bytes]] = {}
    digest = xxhash.xxh32_intdigest
    for word in found:
        words.setdefault(digest(word) % n, []).append(word)
    return [(bucket, sorted(words[bucket])) for bucket in sorted(words)]


def _ask_words(table: pa.Table, n: int):
    packer = zstandard.ZstdCompressor(level=3)
    for bucket, words in _words(table, n):
        yield bucket, packer.compress(b" ".join(words))


def _encode(payloads: list[bytes], definition: str) -> list[bytes]:
    """The number of ids of each word, then all ids; each distinct word is encoded once."""
    asked = [zstandard.decompress(x).split(b" ") for x in payloads]
    place: dict[bytes, int] = {}
    for words in asked:
        for word in words:
            place.setdefault(word, len(place))
    tokenizer = _tokenizer(definition)
    every = list(place)
    counts = np.zeros(len(every), "<u4")
    ids = []
    for low in range(0, len(every), 10_000):
        batch = [x.decode() for x in every[low : low + 10_000]]
        for k, got in enumerate(tokenizer.encode_batch_fast(batch, add_special_tokens=False), low):
            found = got.ids
            counts[k] = len(found)
            ids += found
    ids = np.array(ids, "<u4")
    starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    packer = zstandard.ZstdCompressor(level=1)
    out = []
    for words in asked:
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        body = np.concatenate([counts[at], ids[_expand(starts[at], counts[at])]]).astype("<u4")
        # Byte planes: the high bytes are nearly all zero.
        out.append(packer.compress(np.ascontiguousarray(body.view(np.uint8).reshape(-1, 4).T).tobytes()))
    return out


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, one run after another."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _assemble(table: pa.Table, answers: dict[int, bytes], n: int, definition: str) -> pa.Table:
    pieces = _pieces(definition)
    place: dict[bytes, int] = {}
    counts, ids = [], []
    for bucket, words in _words(table, n):
        planes = np.frombuffer(zstandard.decompress(answers[bucket]), np.uint8).reshape(4, -1)
        body = np.ascontiguousarray(planes.T).reshape(-1).view("<u4")
        counts.append(body[: len(words)])
        ids.append(body[len(words) :])
        place.update(zip(words, range(len(place), len(place) + len(words)), strict=True))
    counts = np.concatenate([np.zeros(0, "<u4"), *counts]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, "<u4"), *ids])
    starts = np.concatenate([[0], np.cumsum(counts)])
    decoded_pieces = [pieces[x] for x in ids.tolist()]
    edges = starts.tolist()
    spelt = [b" ".join(decoded_pieces[a:b]) for a, b in zip(edges, edges[1:])]
    del decoded_pieces
    out_ids, n_tokens, token_ids, decoded = [], [], [], []
    for doc_ids, texts in B.documents(table):
        out_ids.append(doc_ids)
        for text in texts:
            words = text.split()
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            found = ids[_expand(starts[at], counts[at])]
            n_tokens.append(len(found))
            token_ids.append(found.tobytes())
            decoded.append(b" ".join(filter(None, map(spelt.__getitem__, at.tolist()))))
    return pa.table(
        {
            "doc_id": B.ids_out(np.concatenate(out_ids)),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "ids": pa.array(token_ids, pa.binary()),
            "decoded": pa.array(decoded, pa.binary()).cast(pa.string()),
        }
    )
