"""Near duplicates: an n-gram Jaccard join filtered under several global token orders.

If two sets are similar, then under *any* global order of tokens the first few of each,
its prefix, have one in common. One order lets unrelated sets through that share a common
passage; they seldom do so under several orders, so candidates must pass all of them.

1. Equal sets are one class; only one document of it goes on.
2. For each of several hash orders a class asks which tokens of its prefix another class
   has in its prefix too. A similar pair has a known number of these under every order, so
   classes with fewer under any order are done: they are similar to nothing.
3. Those left, usually a few, meet again under orders that put rare tokens first. Classes
   that share a prefix token and have similar sizes fall into one coarse group per order;
   similar classes share their group under every order, and only groups that agree under
   all orders are compared.
4. Within a group the links are searched by ``groups.py``, which cuts a group that is too
   large for a task. What comes out are spanning trees, never pairs, and their components.

A passage or near copy that a third of all documents share is one entry per block and
token in steps 2 and 3 and one tree edge per document in step 4.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.llm import blocks as B
from dataroute.llm import hashing as H
from dataroute.llm.components import components
from dataroute.llm.exact_dedup import digest
from dataroute.llm.filters import maybe_among
from dataroute.llm.groups import links_within, token_sets
from dataroute.llm.shipping import ship
from dataroute.llm.tables import join_facts, written

#: Words of a shingle and least similarity, in per cent.
WORDS, PERCENT = 5, 80
#: One number per global order of tokens.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Tokens of a block of documents that are left after step 2.
BLOCK_TOKENS = 1 << 18

SETS = "doc_id long, n_shingles long, class_id long, tokens binary"
#: The set's print and the text's digest, where rows are told apart by more than their ids.
ROWS = SETS + ", print binary, digest string"
STARS = "a long, b long"


def _least_overlap(n, percent: int):
    """Tokens that a set of ``n`` shares at least with a similar one."""
    return -(-n * percent // 100)


def _prefix(n, percent: int):
    return n - _least_overlap(n, percent) + 1


def _extra(n, percent: int):
    """Tokens behind the prefix that are asked about too."""
    return np.minimum(_prefix(n, percent) // 2, n - _prefix(n, percent))


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every document.

    Words are runs of bytes other than ASCII white space with A-Z lowered; a document's
    set are its distinct runs of ``words`` words, or all its words as one if it has fewer.
    Two documents link when ``100 * intersection >= percent * union``. ``component_id`` is
    the smallest doc_id that links reach. Every link is found.

    A null text or one without words has an empty set and links with nothing. A null id
    counts as larger than all others. Rows with equal ids are one document with several
    sets: links of one are links of all. Other columns are not read.
    """
    sets, going, found = _sets_and_links(docs, words, percent, doc_id, text, SETS)
    for end in ("a", "b"):
        ends = going.select(F.col("number").alias(end), F.col("class_id").alias(f"class_{end}"))
        found = found.join(ends, end)
    rows = sets.select("doc_id", "n_shingles", "class_id")
    total = rows.count()
    # A class is named by an id, so an id with several of them ties these to itself.
    several = rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("class_id").alias("low"), F.max("class_id").alias("high")
    )
    several = written(several.filter("low < high").select("doc_id", "n"), "several")
    tied = join_facts(rows, several, "doc_id", "n", total).filter("doc_id != class_id")
    edges = found.select("class_a", "class_b").unionAll(tied.select("doc_id", "class_id").distinct())
    links = components(edges, "class_a", "class_b")
    classes = rows.groupBy("class_id").agg(F.count("*").alias("n"))
    classes = classes.join(links.withColumnRenamed("node", "class_id"), "class_id", "left")
    null = F.lit(int(B.NULL_ID))
    return join_facts(rows, written(classes, "classes"), "class_id", "n", total).select(
        F.nullif("doc_id", null).alias("doc_id"),
        "n_shingles",
        F.nullif(F.coalesce("component", "class_id"), null).alias("component_id"),
    )


def _sets_and_links(docs: DataFrame, words: int, percent: int, doc_id: str, text: str, schema: str):
    """Rows with their classes, those of them that were compared, and edges between these."""
    ship(docs.sparkSession)
    n = B.block_count(docs, text)
    dealt = B.frames(docs, n, doc_id, text)
    classes = B.answer(B.ask(dealt, n, lambda table: _ask_classes(_Sets(table, words), n)), n, _reply_least)
    shared = B.answer(
        B.ask_again(dealt, classes, n, lambda table, got: _ask_prefixes(_Sets(table, words), got, n, percent)),
        n,
        B.reply_shared,
    )
    answers = B.both(classes, shared, n)
    keyed = schema == ROWS
    finished = B.finish(
        dealt, answers, lambda table, got: _left(_Sets(table, words, keyed), got, n, percent), schema, ("tokens",)
    )
    # Ids can be any number, so links are searched between rows' numbers, fixed by writing.
    sets = written(finished.withColumn("number", F.monotonically_increasing_id()), "sets")
    going = sets.filter("tokens IS NOT NULL")
    return sets, going, _links(going.select("number", "tokens"), percent)


def without_near_copies(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows that stay, one document per group of near copies, with all their columns.

    A document is an id and a text here: rows without an id or with the same one are judged
    by their own texts. Of a group the document with the smallest id stays (nulls last), of
    equal ids the one whose text has the least digest. Rows that agree in id and text all
    stay or all go.
    """
    sets, going, found = _sets_and_links(docs, words, percent, doc_id, text, ROWS)
    linked = components(found).join(going.select(F.col("number").alias("node"), "print"), "node")
    linked = linked.groupBy("print").agg(F.min("component").alias("linked"))
    rows = sets.filter("print IS NOT NULL").select("doc_id", "digest", "print", "number")
    total = rows.count()
    # A class without links is a group of its own, under the number of one of its rows.
    groups = (
        rows.groupBy("print").agg(F.count("*").alias("n"), F.min("number").alias("least"))
        .join(linked, "print", "left")
        .filter("n > 1 OR linked IS NOT NULL")
        .select("print", "n", F.coalesce("linked", "least").alias("group"))
    )
    members = join_facts(rows, written(groups, "groups"), "print", "n", total)
    members = written(members.select("group", F.struct("doc_id", "digest").alias("member")), "members")
    first = members.groupBy("group").agg(F.min("member").alias("first"), F.count("*").alias("n"))
    dropped = join_facts(members, written(first, "first"), "group", "n", total).filter("member != first")
    dropped = written(
        dropped.select(
            F.nullif("member.doc_id", F.lit(int(B.NULL_ID))).alias("dropped_id"),
            F.col("member.digest").alias("dropped_digest"),
        ).distinct(),
        "dropped",
    )
    return _without(docs, dropped, doc_id, text)


def _without(docs: DataFrame, dropped: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose id and text are not ``dropped``; texts stay where they are.

    A filter over the dropped keys passes most rows straight on. Keys that it only seems to
    hold are told apart by a join of keys and put into a second filter: rows in the first
    one alone are dropped, and only the few in both are shuffled to be compared.
    """
    if dropped.isEmpty():
        return docs
    keyed = docs.select(
        F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"),
        F.col(doc_id).cast("long").alias("row_id"),
        digest(docs[text]).alias("row_digest"),
    )
    own = ("row_id", "row_digest")
    same = F.col("row_id").eqNullSafe(F.col("dropped_id")) & (F.col("row_digest") == F.col("dropped_digest"))
    is_dropped = maybe_among(dropped)(*own)
    spared = keyed.select(*own).filter(is_dropped).join(dropped, same, "left_anti").distinct()
    is_spared = maybe_among(written(spared, "spared"))(*own)
    compared = keyed.filter(is_dropped & is_spared).join(dropped, same, "left_anti")
    return keyed.filter(~is_dropped).unionAll(compared).select("row.*")


class _Sets:
    """The sets of a block's documents, and their classes within the block."""

    def __init__(self, table: pa.Table, words: int, keyed: bool = False):
        ids, self.sets = [], []
        self.digests: list[str] | None = [] if keyed else None
        for doc_ids, texts in B.documents(table):
            ids.append(doc_ids)
            if keyed:
                self.digests += [hashlib.sha256(x).hexdigest() for x in texts]
            (hashes,), first = H.words_of(texts, lower=True)
            full = np.arange(max(0, len(hashes) - words + 1))
            grams = H.windows(hashes, full, words) if len(full) else hashes[:0]
            for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if high - low >= words:
                    own = np.sort(grams[low : high - words + 1])
                    self.sets.append(own[np.r_[True, own[1:] != own[:-1]]])
                elif high > low:
                    # Shorter than a shingle: its hash depends on the number of words.
                    whole = H.windows(hashes, np.array([low]), high - low, 100 + high - low)
                    self.sets.append(whole)
                else:
                    self.sets.append(hashes[:0])
        self.ids = np.concatenate(ids)
        self.sizes = np.array([len(x) for x in self.sets])
        self.prints = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else b"" for x in self.sets]

    def classes(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Sorted prints of the distinct sets, their least ids, and their numbers per document."""
        prints = sorted(set(self.prints) - {b""})
        place = {x: k for k, x in enumerate(prints)}
        number = np.array([place.get(x, -1) for x in self.prints], np.int64)
        least = np.full(len(prints), B.NULL_ID)
        np.minimum.at(least, number[number >= 0], self.ids[number >= 0])
        return prints, least, number


def _print_buckets(prints: list[bytes], n: int):
    keys = np.frombuffer(b"".join(prints), ">u8")[::2].astype(np.uint64)
    return B.slices(keys, n)


def _ask_classes(sets: _Sets, n: int):
    prints, least, _ = sets.classes()
    for bucket, part in _print_buckets(prints, n):
        yield bucket, least[part].astype("<i8").tobytes() + b"".join(prints[part])


def _reply_least(payloads: list[bytes]) -> list[bytes]:
    """The least id of each asked class over all blocks."""
    least: dict[bytes, int] = {}
    asked = []
    for payload in payloads:
        size = len(payload) // 24
        data = bytes(payload)
        prints = [data[8 * size + 16 * k : 8 * size + 16 * k + 16] for k in range(size)]
        asked.append(prints)
        for own, key in zip(np.frombuffer(data[: 8 * size], "<i8").tolist(), prints, strict=True):
            least[key] = min(own, least.get(key, own))
    return [np.array([least[x] for x in prints], "<i8").tobytes() for prints in asked]


def _class_ids(sets: _Sets, answers: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the id of its class, and whether it is the one that goes on."""
    prints, least, number = sets.classes()
    found = np.empty(len(prints), np.int64)
    for bucket, part in _print_buckets(prints, n):
        found[part] = np.frombuffer(answers[bucket], "<i8")
    class_ids = np.where(number >= 0, found[number] if len(prints) else sets.ids, sets.ids)
    first = np.zeros(len(sets.ids), bool)
    owner = {int(k): i for i, k in reversed(list(enumerate(number))) if k >= 0 and sets.ids[i] == least[k]}
    first[[i for k, i in owner.items() if found[k] == least[k]]] = True
    return class_ids, first


def _prefix_keys(sets: _Sets, going: np.ndarray, percent: int):
    """For each order: keys of the first tokens of all sets that go on, one after another."""
    chosen = [sets.sets[i] for i in np.flatnonzero(going)]
    sizes = sets.sizes[going]
    lengths = _prefix(sizes, percent) + _extra(sizes, percent)
    owner = np.repeat(np.arange(len(chosen)), lengths)
    for order in ORDERS:
        taken = [
            np.partition(mixed, length - 1)[:length] if length < len(mixed) else mixed
            for mixed, length in zip((H.mix(x ^ H.U(order)) for x in chosen), lengths.tolist(), strict=True)
        ]
        # Prefixes hold the smallest values of the order, so keys are mixed once more.
        yield owner, H.mix(np.concatenate([*taken, np.zeros(0, H.U)]) ^ H.U(order))


def _ask_prefixes(sets: _Sets, answers: dict[int, bytes], n: int, percent: int):
    _, going = _class_ids(sets, answers, n)
    keys = np.concatenate([keys for _, keys in _prefix_keys(sets, going, percent)])
    ranked, begins, _ = H.distinct(keys)
    yield from B.ask_shared(ranked, np.diff(np.r_[begins, len(keys)]) > 1, n)


def _left(sets: _Sets, answers: dict[int, bytes], n: int, percent: int) -> pa.Table:
    """All documents with their classes; the sets of classes that may have a link."""
    class_ids, going = _class_ids(sets, {k: v for k, v in answers.items() if k < n}, n)
    orders = list(_prefix_keys(sets, going, percent))
    ranked, begins, order = H.distinct(np.concatenate([keys for _, keys in orders]))
    shared = np.empty(len(order), bool)
    marks = B.read_shared({k - n: v for k, v in answers.items() if k >= n}, ranked, n)
    shared[order] = np.repeat(marks, np.diff(np.r_[begins, len(order)]))
    sizes = sets.sizes[going]
    needed = 1 + _extra(_least_overlap(sizes, percent), percent)
    alive = np.ones(len(sizes), bool)
    for (owner, _), own in zip(orders, np.split(shared, len(orders)), strict=True):
        alive &= np.bincount(owner, weights=own, minlength=len(sizes)) >= needed
    keep = np.zeros(len(going), bool)
    keep[np.flatnonzero(going)[alive]] = True
    columns = {
        "doc_id": pa.array(sets.ids),
        "n_shingles": pa.array(sets.sizes, pa.int64()),
        "class_id": pa.array(class_ids, pa.int64()),
        "tokens": pa.array(
            [x.tobytes() if k else None for x, k in zip(sets.sets, keep, strict=True)], pa.binary()
        ),
    }
    if sets.digests is not None:
        columns["print"] = pa.array([x or None for x in sets.prints], pa.binary())
        columns["digest"] = pa.array(sets.digests, pa.string())
    return pa.table(columns)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` whose components are those of all links between the sets.

    Sets are named by a ``number`` from 0 on: a partition's, times 2^33, and a row's.
    """
    total = sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    n = max(1, -(-total // (8 * BLOCK_TOKENS)), min(total >> 16, sets.sparkSession.sparkContext.defaultParallelism))
    block = F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    dealt = B.deal(sets.withColumn("block", block), n)
    counted = B.answer(B.ask(dealt, n, lambda table: _ask_counts(table, n)), n, _reply_counts)
    stars = B.ask_again(dealt, counted, n, lambda table, got: _post(table, got, n, percent))
    edges = stars.groupBy("bucket").applyInArrow(lambda table: _group(table, percent), STARS)
    # A node per set and order: three graphs in one.
    coarse = components(edges.distinct())
    k = len(ORDERS)
    groups = (
        coarse.select(
            F.expr(f"node DIV {k}").alias("number"),
            F.struct(F.expr(f"node % {k}").alias("order"), "component").alias("part"),
        )
        .groupBy("number")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .filter(F.size("parts") == k)
        .select("number", F.xxhash64("parts").alias("group"))
    )
    return links_within(sets, written(groups, "coarse"), percent)


def _ask_counts(table: pa.Table, n: int):
    _, sets = token_sets(table)
    ranked, begins, order = H.distinct(np.concatenate(sets))
    count = np.diff(np.r_[begins, len(order)]).astype("<u4")
    for bucket, part in B.slices(ranked, n):
        yield bucket, ranked[part].astype("<u8").tobytes() + count[part].tobytes()


def _reply_counts(payloads: list[bytes]) -> list[bytes]:
    sizes = [len(x) // 12 for x in payloads]
    keys = np.concatenate([np.frombuffer(x[: 8 * s], "<u8") for x, s in zip(payloads, sizes, strict=True)])
    count = np.concatenate([np.frombuffer(x[8 * s :], "<u4") for x, s in zip(payloads, sizes, strict=True)])
    _, begins, order = H.distinct(keys)
    total = np.empty(len(keys), "<u4")
    summed = np.add.reduceat(count[order].astype(np.int64), begins)
    total[order] = np.repeat(summed, np.diff(np.r_[begins, len(order)]))
    return [x.tobytes() for x in np.split(total, np.cumsum(sizes)[:-1])]


def _post(table: pa.Table, answers: dict[int, bytes], n: int, percent: int):
    """Prefixes under orders with rare tokens first, as runs and edges (see ``_runs``).

    The sets of this block that share a token are tied together here, so that a token
    sends one run per range of sizes, however many sets of the block have it.
    """
    ids, sets = token_sets(table)
    ranked, begins, order = H.distinct(np.concatenate(sets))
    count = np.empty(len(ranked), np.int64)
    for bucket, part in B.slices(ranked, n):
        count[part] = np.frombuffer(answers[bucket], "<u4")
    counts = np.empty(len(order), np.int64)
    counts[order] = np.repeat(count, np.diff(np.r_[begins, len(order)]))
    keys, nodes, sizes = [], [], []
    per_set = np.split(counts, np.cumsum([len(x) for x in sets])[:-1])
    for own, number, held in zip(per_set, ids.tolist(), sets, strict=True):
        length = int(_prefix(len(held), percent))
        # Rarity in powers of two, so that the orders differ within a cluster of copies.
        rare = np.log2(own).astype(np.int64)
        for k, order_seed in enumerate(ORDERS):
            mixed = H.mix(held ^ H.U(order_seed))
            first = np.lexsort((mixed, rare))[:length]
            first = first[own[first] > 1]
            keys.append(H.mix(mixed[first] + H.U(k)))
            nodes.append(np.full(len(first), number * len(ORDERS) + k))
            sizes.append(np.full(len(first), len(held)))
    keys, nodes, sizes = (np.concatenate(x) for x in (keys, nodes, sizes))
    (keys, nodes, low, high), pairs = _runs(keys, nodes, sizes, sizes, percent)
    for bucket, part in B.slices(keys, n):
        sent = np.stack([keys[part].view(np.int64), nodes[part], low[part], high[part]])
        yield bucket, b"r" + sent.astype("<i8").tobytes()
    places = H.mix(pairs[0].astype(H.U))
    order = np.argsort(places, kind="stable")
    for bucket, part in B.slices(places[order], n):
        yield bucket, b"e" + pairs[:, order[part]].astype("<i8").tobytes()


def _runs(keys, nodes, low, high, percent: int):
    """Ranges of sizes per key without a gap that no similar pair bridges.

    Given are ranges ``low`` to ``high`` of a node each. Returns the joined ranges, each
    with its least node, and the distinct edges from the other nodes to that one.
    """
    if not len(keys):
        return (keys, nodes, low, high), np.zeros((2, 0), np.int64)
    order = np.lexsort((low, keys))
    keys, nodes, low, high = keys[order], nodes[order], low[order], high[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    # The largest size of the key so far: sizes are far below 2^32.
    reach = np.maximum.accumulate((np.cumsum(new) << 32) + high) & 0xFFFFFFFF
    begins = np.flatnonzero(np.r_[True, new[1:] | (100 * reach[:-1] < percent * low[1:])])
    least = np.minimum.reduceat(nodes, begins)
    tied = np.repeat(least, np.diff(np.r_[begins, len(nodes)]))
    pairs = np.unique(np.stack([nodes, tied])[:, nodes != tied], axis=1)
    return (keys[begins], least, low[begins], np.maximum.reduceat(high, begins)), pairs


def _group(table: pa.Table, percent: int) -> pa.Table:
    """Edges of the blocks, and between their runs of one prefix token."""
    runs, pairs = [np.zeros((4, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for payload in B.letters(table)[1]:
        data = bytes(payload)
        into, rows = (runs, 4) if data[:1] == b"r" else (pairs, 2)
        into.append(np.frombuffer(data[1:], "<i8").reshape(rows, -1))
    _, between = _runs(*np.concatenate(runs, axis=1), percent)
    found = np.unique(np.concatenate([*pairs, between], axis=1), axis=1)
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})
