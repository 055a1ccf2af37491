"""Documents in blocks, and questions about keys that many blocks share.

Operators that compare passages of a whole corpus all have one shape. Documents are
dealt over *blocks* by a hash, a few megabytes of text each. A block asks about its
distinct keys: they go, packed, to the *bucket* that owns their hash range. A bucket
sees one entry per block for a key however often the key occurs, so a key that a third
of all documents hold costs it one entry per block. Its answer, packed likewise, goes
back to the block and is read in the order in which the block asked.

Up to ``DIRECT`` blocks write to each bucket themselves. With more the messages go through
relays: blocks and buckets are both cut into about ``sqrt(n)`` rows, a block sends one
message per row of buckets to the relay of its own row and that one, and the relay sends one
message to each bucket of its row. That is two exchanges of ``n * sqrt(n)`` rows in place of
one of ``n * n``, with the same letters in them; answers go back the same way. Exchanges have
``MOST_PARTITIONS`` partitions at most, in which blocks come one after another.

Rows that agree in id and text are one row with a count in what a task sends, and are made
rows again when their block is finished, so a row that a third of all are repeats of comes
to its block once per ``FLUSH_BYTES`` of text.

Nothing depends on the order of rows inside a block, so a block that is computed again
after an executor is lost asks the same question.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.llm.shipping import ship

#: Bytes of text that one block aims at; a single longer document is a block's whole content.
BLOCK_BYTES = 8 << 20
#: Bytes of text that a task gathers before it writes frames.
FLUSH_BYTES = 32 << 20
#: Blocks up to which each writes to every bucket: a message of one is some 500 bytes then.
DIRECT = 4096
#: Partitions of an exchange at most, so that what the driver keeps about them is bounded.
MOST_PARTITIONS = 16_384
#: The id that stands for a null one: it sorts behind all others.
NULL_ID = np.iinfo(np.int64).max

FRAME_SCHEMA = "block int, frame binary"
LETTERS = "items array<struct<sender: int, payload: binary>>"
RELAYED = "relay long, items array<struct<receiver: int, sender: int, payload: binary>>"

_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
_ROW = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary()), ("copies", pa.int32())])
_COPIES = pa.ipc.IpcReadOptions(included_fields=[2])


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for the text of ``docs``: in proportion to its bytes, one per core at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(math.ceil(total / block_bytes), docs.sparkSession.sparkContext.defaultParallelism)


def frames(docs: DataFrame, n_blocks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``block, frame``: the documents dealt over blocks, as compressed Arrow frames.

    A null text is an empty one. Null ids come back as ``NULL_ID``.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        # By the text too, so that documents without an id do not meet in one block.
        F.xxhash64(F.col(doc_id), F.col(text)).alias("hash"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NULL_ID))).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield from _framed(held, n_blocks)
                held, size = [], 0
        if held:
            yield from _framed(held, n_blocks)

    # As many tasks as blocks, whatever the session's number of shuffle partitions.
    return deal(rows.mapInArrow(pack, FRAME_SCHEMA), n_blocks)


def deal(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows with a ``block``, partitioned by it; every round of a query uses this exchange."""
    return rows.repartition(_partitions(n_blocks), "block")


def _partitions(n: int) -> int:
    return min(n, MOST_PARTITIONS)


def _framed(batches: list[pa.RecordBatch], n_blocks: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    table = table.set_column(2, "text", table.column("text").cast(pa.large_binary())).combine_chunks()
    hashes = table.column("hash").to_numpy()
    if not len(hashes):
        return
    block = np.mod(hashes, n_blocks)
    order = np.lexsort((hashes, block))
    block, hashes = block[order], hashes[order]
    # Equal rows are neighbours now; an equal hash alone does not make them equal.
    alike = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    new = np.ones(len(order), bool)
    if len(alike):
        one, other = (table.take(pa.array(order[at])) for at in (alike, alike - 1))
        equal = pc.and_(
            pc.equal(one.column("doc_id"), other.column("doc_id")), pc.equal(one.column("text"), other.column("text"))
        )
        new[alike] = ~equal.to_numpy()
    begins = np.flatnonzero(new)
    copies = np.diff(np.r_[begins, len(order)])
    order, block = order[begins], block[begins]
    starts = np.flatnonzero(np.r_[True, np.diff(block) != 0])
    for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
        part = table.take(pa.array(order[start:end])).select(["doc_id", "text"])
        part = part.append_column("copies", pa.array(copies[start:end], pa.int32()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _ROW, options=_IPC) as writer:
            writer.write_table(part.cast(_ROW))
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([int(block[start])], pa.int32()),
                "frame": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            }
        )


def documents(table: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of each frame of a block."""
    for frame in table.column("frame"):
        rows = pa.ipc.open_stream(frame.as_buffer()).read_all()
        yield rows.column("doc_id").to_numpy(), rows.column("text").to_pylist()


def _copies(table: pa.Table) -> np.ndarray:
    """How many equal rows each document of a block stands for."""
    return np.concatenate(
        [
            pa.ipc.open_stream(frame.as_buffer(), options=_COPIES).read_all().column("copies").to_numpy()
            for frame in table.column("frame")
        ]
    )


def ask(
    dealt: DataFrame, n: int, question: Callable[[pa.Table], Iterator[tuple[int, bytes]]]
) -> DataFrame:
    """Messages to ``n`` buckets, which ``question`` makes of each block's frames."""
    side = _side(n)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _packed("bucket", side, key[0].as_py(), question(table))

    asked = dealt.groupBy("block").applyInArrow(run, _schema("bucket", side))
    return _routed(asked, "bucket", side, n).repartition(_partitions(n), "bucket")


def answer(asked: DataFrame, n: int, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Messages to blocks: what ``reply`` says to the payloads of each of ``n`` buckets."""
    side = _side(n)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks, payloads = letters(table)
        return _packed("block", side, key[0].as_py(), zip(blocks, reply(payloads), strict=True))

    return _routed(asked.groupBy("bucket").applyInArrow(run, _schema("block", side)), "block", side, n)


def ask_again(
    dealt: DataFrame,
    answers: DataFrame,
    n: int,
    question: Callable[[pa.Table, dict[int, bytes]], Iterator[tuple[int, bytes]]],
) -> DataFrame:
    """A further question of blocks that have read the answers to their last one."""
    side = _side(n)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, got: pa.Table) -> pa.Table:
        return _packed("bucket", side, key[0].as_py(), question(table, by_bucket(got)))

    asked = _meet(dealt, answers).applyInArrow(run, _schema("bucket", side))
    return _routed(asked, "bucket", side, n).repartition(_partitions(n), "bucket")


def both(answers: DataFrame, further: DataFrame, n: int) -> DataFrame:
    """The answers to two questions; the buckets of the second count from ``n`` on."""
    moved = F.transform(
        "items", lambda x: F.struct((x["sender"] + n).alias("sender"), x["payload"].alias("payload"))
    )
    return answers.unionAll(further.select("block", moved.alias("items")))


def finish(
    dealt: DataFrame,
    answers: DataFrame,
    rows: Callable[[pa.Table, dict[int, bytes]], pa.Table],
    schema: str,
    once: tuple[str, ...] = (),
) -> DataFrame:
    """The result rows that ``rows`` makes of each block and its answers, one per document.

    Equal rows are rows of their own again; columns of ``once`` are null in all but one.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, got: pa.Table) -> pa.Table:
        return rows(table, by_bucket(got)).append_column("copies", pa.array(_copies(table), pa.int32()))

    finished = _meet(dealt, answers).applyInArrow(run, f"{schema}, copies int")
    every = finished.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return every.select(
        *(
            F.when(F.col("copy") == 1, F.col(x)).alias(x) if x in once else F.col(x)
            for x in finished.columns
            if x != "copies"
        )
    )


def _meet(dealt: DataFrame, answers: DataFrame):
    return dealt.groupBy("block").cogroup(answers.groupBy("block"))


def letters(table: pa.Table) -> tuple[list[int], list[pa.Buffer]]:
    """Who sent what, of all messages to one receiver."""
    senders, payloads = [], []
    for items in table.column("items").chunks:
        flat = items.flatten()
        senders += flat.field("sender").to_pylist()
        payloads += [x.as_buffer() for x in flat.field("payload")]
    return senders, payloads


def by_bucket(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(*letters(table), strict=True))


def _side(n: int) -> int:
    """Blocks in a row of relays, 0 without relays."""
    return 0 if n <= DIRECT else math.isqrt(n - 1) + 1


def _schema(to: str, side: int) -> str:
    return RELAYED if side else f"{to} int, {LETTERS}"


def _packed(to: str, side: int, own: int, items) -> pa.Table:
    """Messages of one sender: a letter each, or with relays all letters for one relay."""
    targets, payloads = [], []
    for target, payload in items:
        targets.append(target)
        payloads.append(payload)
    receiver = np.array(targets, np.int64)
    sender = pa.array(np.full(len(targets), own), pa.int32())
    payload = pa.array(payloads, pa.binary())
    if not side:
        letter = pa.StructArray.from_arrays([sender, payload], ["sender", "payload"])
        each = pa.array(np.arange(len(targets) + 1), pa.int32())
        return pa.table({to: pa.array(receiver, pa.int32()), "items": pa.ListArray.from_arrays(each, letter)})
    order = np.argsort(receiver, kind="stable")
    row = receiver[order] // side
    letter = pa.StructArray.from_arrays(
        [pa.array(receiver, pa.int32()), sender, payload], ["receiver", "sender", "payload"]
    ).take(pa.array(order))
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    edges = pa.array(np.r_[begins, len(row)], pa.int32())
    relay = own // side * side + row[begins]
    return pa.table({"relay": pa.array(relay, pa.int64()), "items": pa.ListArray.from_arrays(edges, letter)})


def _routed(messages: DataFrame, to: str, side: int, n: int) -> DataFrame:
    """One message per relay and receiver; without relays the messages as they are."""
    if not side:
        return messages
    arrived = messages.repartition(_partitions(n), "relay").selectExpr("relay", "inline(items)")
    sorted_out = arrived.groupBy("relay", F.col("receiver").alias(to)).agg(
        F.collect_list(F.struct("sender", "payload")).alias("items")
    )
    return sorted_out.select(to, "items")


def slices(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted unsigned 64-bit ``keys`` and the part of them that each owns."""
    if not len(keys):
        return
    bucket = bucket_of(keys, n_buckets)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
        yield int(bucket[start]), slice(int(start), int(end))


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each key: an equal share of the hash range."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def ids_out(ids: np.ndarray) -> pa.Array:
    """Ids for a result column: ``NULL_ID`` is null again."""
    return pa.array(ids, pa.int64(), mask=np.asarray(ids) == NULL_ID)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def short_keys(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key. The bucket, taken from the high bits, adds to them."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def read_short_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def ask_shared(keys: np.ndarray, multiple: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Ask which of the sorted distinct ``keys`` other blocks hold too.

    ``multiple`` marks those of which this block alone has more than one holder.
    """
    for bucket, part in slices(keys, n_buckets):
        yield bucket, short_keys(keys[part]) + bits(multiple[part])


def reply_shared(payloads: list[bytes]) -> list[bytes]:
    """One bit per key: it has more than one holder, in one block or in several.

    Two keys with the same bucket and low bits count as one: what is marked is a superset,
    and askers compare in full what they go on with.
    """
    sizes, keys, multiple = [], [], []
    for payload in payloads:
        size = len(payload) * 8 // 41
        while size * 5 + -(-size // 8) > len(payload):
            size -= 1
        sizes.append(size)
        keys.append(read_short_keys(payload[: size * 5]))
        multiple.append(unbits(payload[size * 5 :], size))
    keys, multiple = np.concatenate(keys), np.concatenate(multiple)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    count = np.diff(np.r_[begins, len(ranked)])
    shared = np.empty(len(keys), bool)
    shared[order] = np.repeat((count > 1) | np.maximum.reduceat(multiple[order], begins), count)
    return [bits(x) for x in np.split(shared, np.cumsum(sizes)[:-1])]


def read_shared(answers: dict[int, bytes], keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The marks of the sorted distinct ``keys`` that this block asked about."""
    out = np.zeros(len(keys), bool)
    for bucket, part in slices(keys, n_buckets):
        out[part] = unbits(answers[bucket], part.stop - part.start)
    return out
