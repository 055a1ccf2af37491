"""All links between sets that were grouped because they may be similar.

Small groups are dealt over tasks, several to a task, and searched breadth first over an
index of tokens. A group that exceeds a task, such as the near copies that a third of a
corpus may be, is never held whole:

1. Its members are dealt over cells. A cell searches its own members and compares each
   with the group's hub, its least member, of which every cell has a copy. What a cell's
   search ties to a member that links with the hub belongs to the hub.
2. Left are the outsiders. Jaccard distance is a metric, so a link joins only sets whose
   distances to the hub differ by at most the distance of a link: members of the hub that
   are nearer than any outsider allows are done. In a tight group that is everything.
3. What remains is cut by distance to the hub into parts. Outsiders' parts meet the parts
   that are near enough, each two in a task of their own; members of the hub, which are
   connected already, do not meet each other.

What comes out are spanning trees, never pairs. Steps 1 and 2 send each set once and the
hub once a cell; only step 3 repeats sets, and only outsiders and their surroundings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataroute.llm.tables import join_facts, written

#: Tokens of a part of a group, and of the small groups that one task searches together.
PART_TOKENS = 1 << 18

LINKS = "a long, b long"
_JUDGED = "group long, number long, anchor long, distance double, outside boolean"
#: Keeps rounding from separating sets at exactly the distance of a link.
_ROUNDING = 1e-9


def links_within(sets: DataFrame, groups: DataFrame, percent: int, part_tokens: int | None = None) -> DataFrame:
    """``a, b``: edges whose components are those of all links inside the groups.

    ``sets`` has a unique long ``number`` and ``tokens``, sorted distinct 64-bit values;
    ``groups`` gives a number its long ``group``. Sets link when ``100 * intersection >=
    percent * union``. Both tables are read several times: give written ones. A number
    without a group, or in a group of its own, has no edges.
    """
    part = part_tokens or PART_TOKENS
    sets = sets.select("number", "tokens")
    sizes = sets.select("number", F.expr("octet_length(tokens) DIV 8").alias("size"))
    narrow = written(groups.select("group", "number").join(sizes, "number"), "grouped")
    facts = narrow.groupBy("group").agg(
        F.count("*").alias("members"), F.sum("size").alias("total"), F.min("number").alias("hub")
    )
    facts = written(facts.filter("members > 1"), "groups")
    seen = facts.agg(F.sum("members"), F.sum("total"), F.max("total")).first()
    if seen[0] is None:
        return facts.selectExpr("hub AS a", "hub AS b").limit(0)
    narrow = join_facts(narrow, facts, "group", "members", seen[0])
    n = -(-seen[1] // part)
    few = narrow.filter(F.col("total") <= part).select(
        "number", "group", F.pmod(F.xxhash64("group"), F.lit(n)).cast("int").alias("cell")
    )
    found = (
        few.join(sets, "number")
        .repartition(n, "cell")
        .groupBy("cell")
        .applyInArrow(lambda table: _search_groups(table, percent), LINKS)
    )
    if seen[2] <= part:
        return found
    large = written(narrow.filter(F.col("total") > part), "large")
    judged = written(_against_hubs(large, sets, n, percent, part), "judged")
    tied = judged.filter("number != anchor").selectExpr("number AS a", "anchor AS b")
    between = _between_parts(judged, sizes, sets, n, percent, part)
    return found.unionAll(tied).unionAll(between)


def _against_hubs(large: DataFrame, sets: DataFrame, n: int, percent: int, part: int) -> DataFrame:
    """Every member's distance to the hub of its group, and what it was tied to in its cell."""
    cells = F.ceil(F.col("total") / part).cast("int")
    own = F.pmod(F.xxhash64("number"), cells).cast("int")
    dealt = (
        large.withColumn("own", own)
        .withColumn(
            "cell",
            F.explode(F.when(F.col("number") == F.col("hub"), F.sequence(F.lit(0), cells - 1)).otherwise(F.array("own"))),
        )
        .select("group", "cell", "number", "hub", (F.col("cell") == F.col("own")).alias("counts"))
    )
    return (
        dealt.join(sets, "number")
        .repartition(n, "group", "cell")
        .groupBy("group", "cell")
        .applyInArrow(lambda table: _judge(table, percent), _JUDGED)
    )


def _judge(table: pa.Table, percent: int) -> pa.Table:
    numbers, sets = token_sets(table)
    sizes = np.array([len(x) for x in sets])
    hub = int(np.flatnonzero(numbers == table.column("hub")[0].as_py())[0])
    common = Index(sets, np.arange(len(sets))).overlaps(sets[hub])[1]
    union = sizes + sizes[hub] - common
    a, b = search(numbers, sets, percent)
    anchor = dict(zip(b, a, strict=True))
    tied = np.array([anchor.get(x, x) for x in numbers.tolist()])
    inside = set(tied[100 * common >= percent * union].tolist())
    outside = np.array([x not in inside for x in tied.tolist()])
    tied[~outside] = numbers[hub]
    own = table.column("counts").to_numpy(zero_copy_only=False)
    return pa.table(
        {
            "group": table.column("group").filter(pa.array(own)),
            "number": pa.array(numbers[own], pa.int64()),
            "anchor": pa.array(tied[own], pa.int64()),
            "distance": pa.array((1 - common / union)[own], pa.float64()),
            "outside": pa.array(outside[own], pa.bool_()),
        }
    )


def _between_parts(
    judged: DataFrame, sizes: DataFrame, sets: DataFrame, n: int, percent: int, part: int
) -> DataFrame:
    """Links between the outsiders of large groups, and between them and the hub's members."""
    reach = (100 - percent) / 100 + _ROUNDING
    limits = judged.groupBy("group").agg(
        F.min(F.when(F.col("outside"), F.col("distance"))).alias("low"),
        F.max(F.when(F.col("outside"), F.col("distance"))).alias("high"),
        F.count("*").alias("members"),
    )
    limits = written(limits.filter("low IS NOT NULL"), "limits")
    left = join_facts(judged, limits, "group", "members", judged.count())
    left = left.filter(f"outside OR distance BETWEEN low - {reach!r} AND high + {reach!r}")
    left = left.join(sizes, "number").select(
        "group", "number", "size", "outside", F.floor(F.col("distance") / reach).alias("ring")
    )
    left = written(left, "left")
    place = ["group", "ring", "outside"]
    rings = left.groupBy(place).agg(F.ceil(F.sum("size") / part).alias("cuts"))
    parts = rings.select(*place, F.explode(F.sequence(F.lit(1), "cuts")).alias("cut"))
    other = parts.select(*(F.col(x).alias(f"other_{x}") for x in parts.columns))
    # Of two parts, both named in full, the lesser comes first in the name of their cell.
    one, two = (
        F.struct(*(F.col(f"{of}{x}").alias(x) for x in ("ring", "outside", "cut"))) for of in ("", "other_")
    )
    meet = parts.join(other, F.col("group") == F.col("other_group")).filter(
        "(outside OR other_outside) AND abs(ring - other_ring) <= 1"
    )
    meet = written(
        meet.select(*place, "cut", F.least(one, two).alias("i"), F.greatest(one, two).alias("j")).distinct(), "meet"
    )
    cut = left.join(rings, place).withColumn(
        "cut", 1 + F.pmod(F.xxhash64("number"), F.col("cuts"))
    )
    return (
        cut.select(*place, "cut", "number")
        .join(meet, [*place, "cut"])
        .join(sets, "number")
        .select("group", "i", "j", "number", "tokens")
        .repartition(n, "group", "i", "j")
        .groupBy("group", "i", "j")
        .applyInArrow(lambda table: _found(*search(*token_sets(table), percent)), LINKS)
    )


def token_sets(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    numbers = table.column("number").to_numpy()
    return numbers, [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("tokens")]


def _found(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _search_groups(table: pa.Table, percent: int) -> pa.Table:
    numbers, sets = token_sets(table)
    group = table.column("group").to_numpy()
    order = np.argsort(group, kind="stable")
    a, b = [], []
    for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        found = search(numbers[own], [sets[i] for i in own], percent)
        a += found[0]
        b += found[1]
    return _found(a, b)


def search(numbers: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links breadth first: each set is compared with those not yet reached.

    Returns the least number of each component, once per other member, and that member.
    """
    sizes = np.array([len(x) for x in sets])
    index = Index(sets, np.arange(len(sets)))
    unreached = np.ones(len(sets), bool)
    a, b = [], []
    for start in np.argsort(numbers, kind="stable"):
        if not unreached[start]:
            continue
        unreached[start] = False
        queue = [int(start)]
        while queue and unreached.any():
            if unreached.sum() * 2 < len(index.members):
                index = Index(sets, np.flatnonzero(unreached))
            now = queue.pop()
            others, common = index.overlaps(sets[now])
            near = unreached[others] & (100 * common >= percent * (sizes[now] + sizes[others] - common))
            reached = others[near]
            unreached[reached] = False
            queue += reached.tolist()
            a += [int(numbers[start])] * len(reached)
            b += numbers[reached].tolist()
        if not unreached.any():
            break
    return a, b


class Index:
    """Which of the ``members`` hold a token."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.members = members
        tokens = np.concatenate([sets[i] for i in members])
        holder = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
        order = np.argsort(tokens, kind="stable")
        self.holder = holder[order]
        ranked = tokens[order]
        self.begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        self.tokens = ranked[self.begins]
        self.counts = np.diff(np.r_[self.begins, len(ranked)])

    def overlaps(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All members, and how many tokens of ``own`` each holds."""
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        at = at[self.tokens[at] == own]
        counts = self.counts[at]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[at] - (ends - counts), counts)
        return self.members, np.bincount(self.holder[places], minlength=len(self.members))
