"""Reports against brute force on skewed fixtures: a third of the rows in one group."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import dataroute as dr
from dataroute.functions.paths import RULE_FIRST_DOT

QUOTED = r"""(["'])(.+?)\1"""


def base_of(path):
    found = re.search(RULE_FIRST_DOT, path)
    return found.group(1) if found else None


def destination_of(path):
    base = base_of(path)
    return path if base is None else f"s3://b/r/tmp/{base}.parquet"


PATHS = (
    ["hot/one.csv"] * 1000  # one path
    + [f"dir{i}/shared.v{i}.csv" for i in range(1000)]  # one destination
    + [f"p{i % 300}/t{i % 70}.json" for i in range(900)]
    + ["no_extension", "a/no_extension", "", None, "s3://b/r/tmp/one.parquet"] * 20
)


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS], "p string").repartition(7).cache()


def test_collisions(spark, paths):
    sources, rows = defaultdict(set), Counter()
    for path in PATHS:
        if path is not None:
            sources[destination_of(path)].add(path)
            rows[destination_of(path)] += 1
    expected = {(d, len(s), rows[d]) for d, s in sources.items() if len(s) > 1}
    found = dr.redirect_collisions(paths, "p", "b", "r").collect()
    assert {tuple(row) for row in found} == expected
    assert len(found) == len(expected)
    assert ("s3://b/r/tmp/shared.parquet", 1000, 1000) in expected


def test_plan_is_one_row_per_path_and_joins_back(spark, paths):
    plan = dr.redirect_plan(paths, "p", "b", "r")
    distinct = {path for path in PATHS if path is not None}
    assert {tuple(row) for row in plan.collect()} == {
        (path, base_of(path), destination_of(path), destination_of(path) != path)
        for path in distinct
    }
    assert plan.count() == len(distinct)
    joined = paths.join(plan, paths.p == plan.path)
    assert joined.count() == sum(path is not None for path in PATHS)


def test_inventory(spark):
    """Hot names, hot ids and ids that more than one row carries."""
    rows = (
        [(i, "read('hot.csv', \"hot.csv\")") for i in range(500)]
        + [(7, f"read('other{i % 11}.json')") for i in range(500)]
        + [(i % 50, "nothing 'here' and \"there\"") for i in range(300)]
        + [(1, None), (None, "'lost.csv'"), (2, "")]
    )
    texts, literals = defaultdict(set), Counter()
    for key, text in rows:
        for match in re.finditer(QUOTED, text or ""):
            base = base_of(match.group(2))
            if base:
                literals[base] += 1
                texts[base] |= {key} - {None}
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(5)
    found = dr.literal_inventory(df, "k", "t").collect()
    assert {tuple(row) for row in found} == {
        (base, len(texts[base]), n) for base, n in literals.items()
    }
    assert len(found) == len(literals)


def test_one_destination_for_every_row(spark):
    hot = spark.range(0, 30_000, numPartitions=6).select(
        F.concat(F.lit("d"), F.col("id"), F.lit("/same.csv")).alias("p")
    )
    found = dr.redirect_collisions(hot, "p", "b", "r").collect()
    assert [tuple(row) for row in found] == [("s3://b/r/tmp/same.parquet", 30_000, 30_000)]


def test_rows_get_the_destination_of_a_hot_path(spark, monkeypatch):
    from dataroute.operators import joins

    monkeypatch.setattr(joins, "LEAST_HOT", 50)
    path = "CASE WHEN id % 3 = 0 THEN 'hot/x.csv' WHEN id % 7 > 0 THEN concat(id % 5, '/', id % 20, '.csv') END"
    rows = spark.range(400).selectExpr("id", f"{path} AS `my path`")
    plan = dr.redirect_plan(rows, "my path", "b", "r")
    meet = plan.groupBy("destination").count().collect()
    meet = {x.destination: x["count"] for x in meet}
    where = {x.path: x.destination for x in plan.collect()}
    got = dr.redirect_rows(rows, "my path", "b", "r")
    assert got.columns == ["id", "my path", "destination", "n_paths"]
    expected = [(x.id, x[1], where.get(x[1]), meet.get(where.get(x[1]))) for x in rows.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    with pytest.raises(ValueError, match="n_paths"):
        dr.redirect_rows(rows.withColumn("n_paths", F.lit(1)), "my path", "b", "r")
