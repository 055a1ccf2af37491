"""Scripts that read and write each other's tables, and joins on hot keys."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import dataroute as dr
from dataroute.operators import joins
from dataroute.queries import spark_side
from dataroute.queries.inputs import PART_JOB

SCRIPTS = [
    (1, 'a = spark.read.parquet(("raw/in.csv")); a.write.mode("append").parquet(\\\n"stage/a.parquet")'),
    (2, "b = spark.readStream.json('other/a.json'); b.writeStream.format('x').save('stage/b.v2.parquet')"),
    (3, 'f"{spark.read.csv("stage/b.csv").count()}"; x.write.save("c.x") # spark.read.csv("d.csv")'),
    (4, 'spark.read.option(x, y[z](w)).load("loop.x").write.mode(f"{m}").save("loop.y")'),
    (5, 'spark.read.load("loop.x"); spark.read.text("c.txt"); spark.read.text(path="e.txt"); x.csv("no")'),
    (6, "nothing here"), (7, None), (8, 'x.write.orc("stage/a.orc")'),
]


def test_accesses_levels_and_reports(spark):
    scripts = spark.createDataFrame(SCRIPTS, "id long, code string")
    accesses = dr.script_accesses(scripts, "id", "code", "b", "r")
    found = {(x.script, x.pos, x.role, x.destination.removeprefix("s3://b/r/tmp/")) for x in accesses.collect()}
    assert found == {
        (1, 0, "read", "in.parquet"), (1, 1, "write", "a.parquet"),
        (2, 0, "read", "a.parquet"), (2, 1, "write", "b.parquet"),
        (3, 0, "read", "b.parquet"), (3, 1, "write", "c.parquet"),
        (4, 0, "read", "loop.parquet"), (4, 1, "write", "loop.parquet"),
        (5, 0, "read", "loop.parquet"), (5, 1, "read", "c.parquet"),
        (8, 0, "write", "a.parquet"),
    }
    unwritten = dr.reads_without_writer(accesses).collect()
    assert [(x.destination[-10:], x.n_readers) for x in unwritten] == [("in.parquet", 1)]
    contested = dr.contested_destinations(accesses).collect()
    assert [(x.destination[-9:], x.n_writers, x.n_readers) for x in contested] == [("a.parquet", 2, 1)]
    levels = dr.script_levels(scripts.select("id"), accesses).collect()
    assert sorted((x.script, x.level, x.cycle) for x in levels) == [
        (1, 0, None), (2, 1, None), (3, 2, None), (4, None, 4), (5, None, None), (6, 0, None), (7, 0, None), (8, 0, None),
    ]
    assert dr.script_levels(scripts.select("id").limit(0), accesses.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_levels_and_cycles_equal_a_plain_search(spark, seed):
    chosen = random.Random(seed)
    n = 40
    uses = {(chosen.randrange(n), chosen.choice(["read", "write"]), f"d{chosen.randrange(30)}") for _ in range(70)}
    uses |= {(k, "read", "hub") for k in range(0, n, 3)} | {(1, "write", "hub"), (None, "read", "d1")}
    accesses = spark.createDataFrame(sorted(uses, key=str), "script long, role string, destination string")
    waits = {s: set() for s in range(n)}
    for s, role, d in uses:
        if role == "read" and s is not None:
            waits[s] |= {w for w, r, e in uses if r == "write" and e == d}

    def reach(s):
        seen, todo = set(), list(waits[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += waits[x]
        return seen

    above = {s: reach(s) for s in range(n)}
    circle = {s: min(x for x in above[s] if s in above[x]) for s in range(n) if s in above[s]}

    def level(s):
        return 1 + max(map(level, waits[s])) if waits[s] else 0

    expected = {
        s: (None if s in circle or above[s] & circle.keys() else level(s), circle.get(s)) for s in range(n)
    }
    got = dr.script_levels(spark.range(n), accesses).collect()
    assert {x.script: (x.level, x.cycle) for x in got} == expected and len(got) == n


def uses_of(spark, waits, kind):
    """Accesses of scripts that wait for each other, each at a destination of its own."""
    uses = [x for a, b in waits for x in ((a, "read", f"d{b}"), (b, "write", f"d{b}"))]
    return spark.createDataFrame(uses, f"script {kind}, role string, destination string")


def test_a_level_is_one_table(spark, monkeypatch):
    n, tables, write = 16, [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a: (tables.append(path), write(self, path, *a)))
    got = dr.script_levels(spark.range(n), uses_of(spark, [(k + 1, k) for k in range(n - 1)], "long"))
    assert {x.script: (x.level, x.cycle) for x in got.collect()} == {k: (k, None) for k in range(n)}
    assert len(tables) < 3 * n


@pytest.mark.parametrize(
    ("name", "least"), [(lambda k: k, 1), (lambda k: 100 - k, 10**6), (lambda k: f"s{k * 37 % 101}", 10**6)]
)
def test_cycles_behind_cycles(spark, name, least, monkeypatch):
    """Three cycles in a row, a script between each two, one that waits for itself, a tail."""
    monkeypatch.setattr(joins, "LEAST_HOT", least)
    circles = [(10, 11, 12), (20, 21), (30, 31, 32, 33), (40,)]
    waits = [(x[k], x[k - 1]) for x in circles for k in range(len(x))]
    waits += [(5, 11), (20, 5), (25, 21), (31, 25), (6, 33), (40, 6), (50, 40), (51, 50), (10, 1), (1, 0)]
    kind = "string" if isinstance(name(0), str) else "long"
    accesses = uses_of(spark, [(name(a), name(b)) for a, b in waits], kind)
    expected = {name(x): (None, min(map(name, circle))) for circle in circles for x in circle}
    expected |= {name(x): (None, None) for x in (5, 25, 6, 50, 51)}
    expected |= {name(0): (0, None), name(1): (1, None), name(2): (0, None)}
    ids = spark.createDataFrame([(x,) for x in expected] * 2, f"id {kind}")
    got = dr.script_levels(ids, accesses).collect()
    assert {x.script: (x.level, x.cycle) for x in got} == expected and len(got) == len(expected)


def test_rows_that_take_long_go_to_all_cores(spark, tmp_path):
    """One file with one group of rows: Spark alone would give it to one task."""
    rows = [(k if k % 9 else None, f"Brand#{k % 5}", "unused") for k in range(400)] * 2
    df = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").coalesce(1)
    df.write.parquet(f"{tmp_path}/part.parquet")
    jobs = spark_side.jobs(spark, str(tmp_path))
    assert jobs.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    expected = spark.read.parquet(f"{tmp_path}/part.parquet").select("p_partkey", F.expr(PART_JOB).alias("code"))
    assert sorted(map(str, jobs.collect())) == sorted(map(str, expected.collect()))
    assert dr.spread(df.limit(0), "none").collect() == []


def test_no_file_has_too_many_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    df = dr.spread(spark.range(10 * cores + 1), "many")
    counts = [x["count"] for x in df.groupBy("_metadata.file_path").count().collect()]
    assert len(counts) == 2 * cores and max(counts) <= 10 and sum(counts) == 10 * cores + 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("least", [1, 500, 10**6])
def test_joins_on_hot_keys(spark, how, least, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_HOT", least)
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 > 0 THEN id END AS k", "id AS x")
    facts = spark.range(0, 3000, 2).selectExpr("id AS k", "id * 2 AS y").unionAll(spark.sql("SELECT 7, 14"))
    got = dr.join_hot(rows, facts, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(facts, "k", how).collect()))


def test_hot_rows_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_HOT", 500)
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = dr.join_hot(rows, rows.groupBy("k").agg(F.max("x").alias("y")), "k")._jdf.queryExecution()
        hot, _, others = plan.executedPlan().toString().partition("SortMergeJoin")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in hot and "hashpartitioning" not in hot and "hashpartitioning" in others
