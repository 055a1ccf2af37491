"""Secrets in texts, told from copied examples by who else has them.

Patterns find candidates. A credential that works belongs to one owner; a value that the
documents of many owners share is an example from some manual. So candidate values are
hashed, hashes are counted over the whole corpus by distinct repositories and owners, and
each candidate gets a verdict: ``live`` or ``example``.

Everything is built-in expressions. A pattern's matches come with their places from the
pieces between them: ``split`` gives the gaps, ``regexp_extract_all`` the matches. The
counts combine before they shuffle, so a value that a third of all documents hold is one
row per task and owner, and the verdict on it is broadcast; texts are never shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataroute.llm.tables import join_facts, written


class Kind(NamedTuple):
    """A pattern whose group ``value`` is the secret, if that has ``least`` characters."""

    name: str
    pattern: str
    value: int
    least: int


# Fixed by the contract. The last two patterns say "so many characters at least" within
# the pattern, which finds the same as dropping short matches of a run.
BASE = (
    Kind(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Public formats of issued keys. These matches become spans only if they look live.
ISSUED = Kind(
    "key",
    r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    0,
    16,
)
KINDS = (*BASE, ISSUED)
#: A value that this many owners have is an example.
EXAMPLE_OWNERS = 4

_SPAN = "array<struct<start:long,rank:int,end:long,kind:string,hash:string>>"


def _matches(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of one kind: places in code points, and the hash of the value."""
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.value)) if kind.value else found
    parts = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"), found.alias("found"), values.alias("value")
    )

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["found"])
        span = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            F.when(F.length(part["value"]) >= kind.least, F.sha2(part["value"].cast("binary"), 256)).alias("hash"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    # The last gap has no match behind it.
    spans = _running(F.filter(parts, lambda x: x["found"].isNotNull()), add, _SPAN)
    return F.when(
        text.rlike(kind.pattern), F.filter(spans, lambda x: x["hash"].isNotNull())
    ).otherwise(F.array().cast(_SPAN))


def _chunks(items: Column) -> Column:
    """``items``, of which there is one at least, in about as many arrays as each has items.

    A fold that appends copies what it has; over chunks, and in each over its items, the
    copies grow with the power 1.5 of the items and not with their square.
    """

    def cut(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(own), size), lambda k: F.slice(own, k, size))

    # An array of one, so that the items are computed once and not once a chunk.
    return F.get(F.transform(F.array(items), cut), F.lit(0))


def _running(items: Column, add, kind: str) -> Column:
    """The spans that ``add`` makes one after another, each from where the last one ended."""

    def chunk(state: Column, own: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(kind).alias("spans"))
        done = F.aggregate(own, start, add)
        return F.struct(
            done["at"].alias("at"), F.concat(state["spans"], F.array(done["spans"])).alias("spans")
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("spans"))
    return F.aggregate(_chunks(items), start, chunk, lambda s: F.flatten(s["spans"]))


def _any(text: Column) -> Column:
    """Whether some pattern matches."""
    condition = F.lit(False)
    for kind in KINDS:
        condition = condition | text.rlike(kind.pattern)
    return condition


def _spelt(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def find_candidates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source"
) -> DataFrame:
    """Candidates of every row in one scan, written: ``row`` names the row from here on.

    ``digest`` is that of a text with a candidate, else null.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.when(_any(content), F.sha2(content.cast("binary"), 256)).alias("digest"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        *[_matches(content, kind, rank).alias(kind.name) for rank, kind in enumerate(KINDS)],
    )
    return written(found.withColumn("row", F.monotonically_increasing_id()), "candidates")


def ownership(candidates: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per hashed value: ``n_spans``, ``n_documents``, ``n_repositories``, ``n_owners``, ``verdict``.

    ``verdict`` is ``example`` if at least ``example_owners`` owners have the value, else
    ``live``. Null owners and repositories count as one, without a name.
    """
    spans = candidates.select(
        "row", "repository", "owner", F.explode(F.concat(*[F.col(k.name) for k in KINDS])).alias("span")
    ).select("row", "repository", "owner", F.col("span.hash").alias("hash"))
    held = spans.groupBy("hash", "repository", "owner").agg(
        F.count("*").alias("m"), F.count_distinct("row").alias("n")
    )
    return held.groupBy("hash").agg(
        F.sum("m").alias("n_spans"),
        F.sum("n").alias("n_documents"),
        F.count_distinct("repository").alias("n_repositories"),
        F.count_distinct("owner").alias("n_owners"),
    ).withColumn("verdict", F.when(F.col("n_owners") >= example_owners, "example").otherwise("live"))


def _live(candidates: DataFrame, example_owners: int) -> DataFrame:
    """``row``, ``doc_id``, ``digest`` and the spans of that row whose values look live."""
    verdicts = written(ownership(candidates, example_owners).select("hash", "verdict", "n_spans"), "verdicts")
    every = F.concat(*[F.col(k.name) for k in KINDS])
    spans = candidates.select("row", "doc_id", "digest", F.explode(every).alias("span"))
    total = verdicts.agg(F.sum("n_spans")).first()[0] or 0
    return (
        join_facts(spans.withColumn("hash", F.col("span.hash")), verdicts, "hash", "n_spans", total)
        .filter("verdict = 'live'")
        .groupBy("row", "doc_id", "digest")
        .agg(F.collect_list("span").alias("live"))
    )


def find_secrets(
    docs: DataFrame,
    example_owners: int = EXAMPLE_OWNERS,
    doc_id: str = "doc_id",
    text: str = "text",
    repository: str = "source",
    owner: str = "source",
) -> DataFrame:
    """Spans of secrets in every row.

    Returns ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` (spans of these
    three kinds as ``kind:start:end``, by start and kind, joined by commas; places in code
    points, end exclusive), ``spans`` (the same with issued keys that look live) and
    ``live`` (all spans whose value looks live, as structs). One row per input row.

    A null or empty text has no spans. Null and repeated doc_ids are rows of their own;
    a row that is there twice counts as two documents of one owner.
    """
    candidates = find_candidates(docs, doc_id, text, repository, owner)
    every = F.concat(*[F.col(k.name) for k in KINDS])
    live = _live(candidates, example_owners).drop("doc_id", "digest")
    base = F.concat(*[F.col(k.name) for k in BASE])
    some = candidates.filter(F.size(every) > 0).join(live, "row", "left")
    none = candidates.filter(F.size(every) == 0).withColumn("live", F.lit(None).cast(_SPAN))
    rows = some.unionByName(none).withColumn(
        "live", F.array_sort(F.coalesce(F.col("live"), F.array().cast(_SPAN)))
    )
    issued = F.filter("live", lambda x: x["kind"] == ISSUED.name)
    return rows.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE],
        _spelt(base).alias("base"),
        _spelt(F.concat(base, issued)).alias("spans"),
        "live",
    )


MARK = "[secret]"


def redact(
    docs: DataFrame,
    example_owners: int = EXAMPLE_OWNERS,
    doc_id: str = "doc_id",
    text: str = "text",
    repository: str = "source",
    owner: str = "source",
    n_chars: str = "n_chars",
) -> DataFrame:
    """All rows with all their columns; secrets that look live are replaced by ``[secret]``.

    Examples stay. Spans that overlap become one mark. ``n_chars``, if there is such a
    column, counts the characters of a changed text anew. Only rows in which a pattern
    matches are shuffled; the others, null texts among them, pass straight through.
    """
    candidates = find_candidates(docs, doc_id, text, repository, owner)
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])
    content = F.col(names[text])
    hit = F.coalesce(_any(content), F.lit(False))
    key, digest = F.col(names[doc_id]).cast("long"), F.sha2(content.cast("binary"), 256)
    # Rows that agree in id and text have the same spans, so one of them will do.
    live = _live(candidates, example_owners).groupBy("doc_id", "digest").agg(F.max("live").alias("live"))
    some = rows.filter(hit).withColumn("key", key).withColumn("own", digest)
    joined = some.join(live, some["key"].eqNullSafe(live["doc_id"]) & (some["own"] == live["digest"]), "left")
    # In a step of its own: a name inside a lambda would also find a new column of that name.
    has = F.col("live").isNotNull()
    joined = joined.withColumn("masked", F.when(has, _masked(content, F.array_sort("live"))))
    changed = {names[text]: F.when(has, F.col("masked")).otherwise(content)}
    if n_chars in names:
        counted = F.length("masked").cast(docs.schema[n_chars].dataType)
        changed[names[n_chars]] = F.when(has, counted).otherwise(F.col(names[n_chars]))
    marked = joined.select(*[changed.get(x, F.col(x)).alias(x) for x in names.values()])
    out = rows.filter(~hit).unionAll(marked)
    return out.select(*[F.col(new).alias(old) for old, new in names.items()])


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with a mark for each stretch that ``spans``, sorted and at least one, cover.

    The text is cut at every so many spans first, so that finding a place in it costs a part.
    """

    def cut(state: Column, own: Column) -> Column:
        last = F.array_max(F.transform(own, lambda x: x["end"]))
        end = F.greatest(state["at"], last)
        part = F.struct(
            state["at"].alias("at"), _between(text, state["at"], end).alias("text"), own.alias("spans")
        )
        return F.struct(end.alias("at"), F.concat(state["parts"], F.array(part)).alias("parts"))

    def mask(part: Column) -> Column:
        def add(state: Column, span: Column) -> Column:
            ahead = span["start"] >= state["at"]
            plain = _between(part["text"], state["at"] - part["at"], span["start"] - part["at"])
            return F.struct(
                F.greatest(state["at"], span["end"]).alias("at"),
                F.when(ahead, F.concat(state["out"], plain, F.lit(MARK))).otherwise(state["out"]).alias("out"),
            )

        start = F.struct(part["at"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(part["spans"], start, add, lambda s: s["out"])

    part = "struct<at:long,text:string,spans:" + _SPAN + ">"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{part}>").alias("parts"))
    return F.aggregate(
        _chunks(spans),
        start,
        cut,
        lambda s: F.concat(
            F.array_join(F.transform(s["parts"], mask), ""), _between(text, s["at"], F.length(text))
        ),
    )


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
