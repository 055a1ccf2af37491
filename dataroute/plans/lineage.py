"""Which scripts read what other scripts write, once all of it is redirected.

Reader and writer meet at a destination, not at a path: scripts that name one table by
different paths meet, and so do scripts whose tables would collide. Scripts and destinations
are the nodes of a graph, with an edge from a script to what it writes and from there to
every reader, so a destination with many writers and many readers has as many edges as
accesses and not as many as pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from dataroute.functions import scanner
from dataroute.functions.paths import redirect_path
from dataroute.operators import joins
from dataroute.operators.joins import hot_keys, join_hot, written
from dataroute.sources.scratch import scratch_location

#: Methods of readers and writers whose first argument is a path.
PATH_METHODS = ("parquet", "csv", "json", "orc", "text", "load", "save")

READ, WRITE = scanner.READ, scanner.WRITE


def script_accesses(
    df: DataFrame, id_col: str, text_col: str, bucket: str, run_id: str, methods: tuple[str, ...] = PATH_METHODS
) -> DataFrame:
    """``(script, pos, role, literal, destination)`` for every read and write of a script.

    An access is a call of one of ``methods`` with a plain string literal first, as the
    scanner of the language sees it, in a chain that has an attribute ``read`` or ``write``
    (or their streaming forms); the last one gives its ``role``. ``destination`` is the
    redirected path, or the path itself if it has no base name. One pass over the texts.
    """
    text = F.col(text_col)
    named = df.filter(text.rlike(r"\.\s*(?:read|write)") & text.rlike("|".join(methods)))
    found = F.struct(scanner.call_places(text, methods).alias("places"), scanner.pieces(text).alias("pieces"))

    def read(x):
        def access(place):
            literal = scanner.literal_of(x["pieces"], place)
            return F.struct(place["role"].alias("role"), literal.alias("literal"))

        return F.transform(F.filter(x["places"], lambda place: place["role"].isNotNull()), access)

    accesses = F.get(F.transform(F.array(found), read), F.lit(0))
    rows = named.select(F.col(id_col).alias("script"), F.posexplode(accesses).alias("pos", "access"))
    content = scanner.content(F.col("access.literal"))
    return rows.select("script", "pos", "access.role", content.alias("literal")).withColumn(
        "destination", redirect_path("literal", bucket, run_id)
    )


def destination_use(accesses: DataFrame) -> DataFrame:
    """``(destination, n_writers, n_readers)``: scripts that write and read a destination.

    Accesses are counted per script and destination first, so a destination that a third
    of all scripts read is one row per task in the second shuffle.
    """
    per_script = accesses.groupBy("destination", "script").agg(
        F.max((F.col("role") == WRITE).cast("int")).alias("writes"),
        F.max((F.col("role") == READ).cast("int")).alias("reads"),
    )
    return per_script.groupBy("destination").agg(
        F.sum("writes").alias("n_writers"), F.sum("reads").alias("n_readers")
    )


def reads_without_writer(accesses: DataFrame) -> DataFrame:
    """``(destination, n_readers)`` of destinations that scripts read and none writes."""
    return destination_use(accesses).filter("n_writers = 0").select("destination", "n_readers")


def contested_destinations(accesses: DataFrame) -> DataFrame:
    """Destinations that several scripts write, with their numbers of writers and readers."""
    return destination_use(accesses).filter("n_writers > 1")


def script_levels(scripts: DataFrame, accesses: DataFrame) -> DataFrame:
    """``(script, level, cycle)`` for every one of ``scripts``, a table of their ids.

    Level 0 reads nothing that a script writes; others are one above the highest script
    that writes something they read. Scripts that wait for each other, or for themselves,
    have no level and name their ``cycle`` by its least script; those behind a cycle have
    neither. Every level is one round of joins, from scripts through destinations to
    scripts, and is written.
    """
    ids = scripts.toDF("script").filter("script IS NOT NULL").distinct()
    kind = ids.schema["script"].dataType
    node = F.col("script")
    if not isinstance(kind, IntegralType) or accesses.schema["script"].dataType != kind:
        node = node.cast("string")
    uses = accesses.filter("script IS NOT NULL").select(node.alias("node"), "destination", "role")
    reads, writes = _edges(written(uses.distinct(), "accesses"))
    rounds, stuck = _waiting(reads, writes)
    found = rounds.groupBy("node").agg((F.max("round") + 1).alias("level"))
    found = found.join(stuck.select("node", F.lit(True).alias("is_stuck")).distinct(), "node", "left")
    found = found.join(_cycles(stuck, writes), "node", "left")
    named = written(ids.withColumn("node", node).join(found, "node", "left"), "levels")
    least = named.filter("cycle IS NOT NULL").groupBy("cycle").agg(F.min("script").alias("least"))
    level = F.when(F.col("is_stuck").isNull(), F.coalesce("level", F.lit(0).cast("long")))
    return named.join(least, "cycle", "left").select("script", level.alias("level"), F.col("least").alias("cycle"))


def _edges(uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, place)`` of reads and of writes, at destinations that are both read and written.

    A destination that nobody writes holds no one up, and one that nobody reads no one either.
    The others get numbers, which stand for them in all rounds.
    """
    both = uses.groupBy("destination").agg(
        F.bool_or(F.col("role") == READ).alias("is_read"), F.bool_or(F.col("role") == WRITE).alias("is_written")
    )
    places = both.filter("is_read AND is_written").select("destination", F.monotonically_increasing_id().alias("place"))
    edges = join_hot(uses, written(places, "places"), "destination").select("node", "place", "role")
    edges = written(edges, "edges")
    return tuple(written(edges.filter(F.col("role") == x).select("node", "place"), x) for x in (READ, WRITE))


def _counted(df: DataFrame, location: str, *sums: Column) -> tuple[DataFrame, int]:
    """``df`` written to a location and read back, and its number of rows or another sum."""
    counted = Observation()
    total = F.sum(*sums) if sums else F.count(F.lit(1))
    df.observe(counted, total.alias("n")).write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location), counted.get["n"] or 0


def _measured(rows: DataFrame, key: str) -> DataFrame | None:
    hot = hot_keys(rows, key)
    return None if hot.isEmpty() else hot


def _held(rows: DataFrame, keys: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """The rows whose key is one of ``keys``, which can repeat; ``hot`` are keys measured in ``rows``."""
    if hot is None:
        return rows.join(keys, key, "left_semi")
    return join_hot(rows, written(keys.distinct(), "held"), key, "left_semi", hot)


def _waiting(own: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``own`` round by round, with the number of the ``round``, and those that stay.

    A row stays as long as its place is in ``other`` one of a node with rows that stay. With
    reads and the writes they wait for these are scripts that wait, whose numbers of rounds
    are their levels; with writes and reads, scripts that others wait for.
    """
    at = scratch_location(own.sparkSession, "rounds")
    own, n = _counted(own, f"{at}/round=0")
    many = n >= joins.LEAST_HOT
    hot_nodes, hot_places = (_measured(other, "node"), _measured(own, "place")) if many else (None, None)
    last, k = n, 0
    while n:
        if n < joins.LEAST_HOT:
            hot_nodes = hot_places = None
        places = _held(other, own.select("node"), "node", hot_nodes).select("place")
        new, left = _counted(_held(own, places, "place", hot_places), f"{at}/round={k + 1}")
        stays = left == n
        own, n, k = new, left, k + 1
        if stays:
            break
        if 2 * n < last:
            other, last = written(_held(other, own.select("node"), "node", hot_nodes), "left"), n
    rounds = own.sparkSession.read.schema(StructType([*own.schema, StructField("round", LongType())])).parquet(at)
    return rounds, own


def _needed(reads: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads that wait for ever, and writes, of scripts that others of them wait for."""
    writes = _waiting(writes.join(reads, "node", "left_semi"), reads)[1]
    reads = reads.join(writes, "node", "left_semi").join(writes, "place", "left_semi")
    return written(reads.select("node", "place", "number"), "reads"), writes


def _cycles(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """``(node, cycle)`` for nodes that reach themselves: groups that reach each other.

    ``reads`` wait for ever. The least and the greatest node that reach a node colour it, and
    nodes of one group have the same colours, so that places are cut into one for each colour.
    What is still on a way from group to group is coloured the other way round, by nodes that
    it reaches, and so in turns. Nodes that reach what reaches them are a group and go.
    """
    found = reads.selectExpr("node", "node AS cycle").limit(0)
    known = reads.selectExpr("node", "node AS lo", "node AS hi").limit(0)
    reads, writes = (x.withColumn("number", F.col("place")) for x in (reads, writes))
    reads, writes = _needed(reads, writes)
    while not reads.isEmpty():
        groups = _coloured(reads, writes).join(known.toDF("node", "least", "greatest"), "node", "left")
        cycle = F.when(F.col("lo") == F.col("least"), F.col("lo")).when(F.col("hi") == F.col("greatest"), F.col("hi"))
        groups = written(groups.select("node", "lo", "hi", cycle.alias("cycle")), "groups")
        found = found.unionAll(groups.filter("cycle IS NOT NULL").select("node", "cycle"))
        known = groups.filter("cycle IS NULL").select("node", "lo", "hi")
        writes, reads = _cut(reads, writes, known)
    return found


def _cut(reads: DataFrame, writes: DataFrame, colours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads and writes of coloured nodes whose colour has a cycle or a way between cycles."""

    def cut(edges: DataFrame) -> DataFrame:
        place = F.struct("number", "lo", "hi").alias("place")
        return written(edges.join(colours, "node").select("node", place, "number"), "cut")

    writes = cut(writes)
    return _needed(_waiting(cut(reads), writes)[1], writes)


def _coloured(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """``(node, lo, hi)``: the least and the greatest node that reach each node, or the node itself."""
    colours = reads.select("node", F.col("node").alias("lo"), F.col("node").alias("hi")).distinct()
    colours = written(colours, "colours")
    least, greatest = F.min("lo").alias("lo"), F.max("hi").alias("hi")

    def step(colours: DataFrame) -> DataFrame:
        places = writes.join(colours, "node").groupBy("place").agg(least, greatest)
        sent = reads.join(places, "place").select("node", "lo", "hi")
        return colours.unionByName(sent).groupBy("node").agg(least, greatest)

    while True:
        # Two steps for each time that colours are written.
        new = step(step(colours)).join(colours.toDF("node", "least", "greatest"), "node")
        changed = (F.col("lo") != F.col("least")) | (F.col("hi") != F.col("greatest"))
        new, n = _counted(new, scratch_location(new.sparkSession, "colours"), changed.cast("long"))
        colours = new.select("node", "lo", "hi")
        if not n:
            return colours
