"""Destinations taken by earlier batches."""

import random

import pytest
from pyspark.sql import functions as F

import dataroute as dr


def _paths(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "path string")


@pytest.mark.parametrize("seed", range(2))
def test_batches_report_like_one_table(spark, tmp_path, seed):
    chosen = random.Random(seed)
    rows = [
        None if chosen.random() < 0.05 else f"{chosen.choice('ab')}/{chosen.randrange(12)}.{chosen.choice(['csv', 'x.y', ''])}"
        for _ in range(200)
    ]
    where = str(tmp_path / "it's taken")
    for k in range(4):
        # Opened anew each time, as by later runs, whatever number of buckets they ask for.
        state = dr.TakenDestinations(spark, where, "b", "r", buckets=4 + k)
        touched = state.add(_paths(spark, rows[50 * k : 50 * k + 50]), "path", f"day {k}").collect()
        so_far = dr.redirect_collisions(_paths(spark, rows[: 50 * k + 50]), "path", "b", "r").collect()
        assert sorted(state.report().collect()) == sorted(so_far)
        batch = dr.redirect_plan(_paths(spark, rows[50 * k : 50 * k + 50]), "path", "b", "r").collect()
        assert sorted(touched) == sorted(x for x in so_far if x.destination in {y.destination for y in batch})
        assert state.buckets == 4
    with pytest.raises(ValueError, match="day 2"):
        state.add(_paths(spark, rows), "path", "day 2")


def test_a_batch_that_stopped_halfway_counts_once(spark, tmp_path, monkeypatch):
    state = dr.TakenDestinations(spark, str(tmp_path / "taken"), "b", "r", buckets=2)
    state.add(_paths(spark, ["a/x.csv", "b/y.csv"]), "path", "one")
    append = state._append
    for stop in ("_destinations", "_paths"):

        def stopping(rows, table, key, stop=stop):
            append(rows, table, key)
            if table == getattr(state, stop):
                raise RuntimeError("lost")

        monkeypatch.setattr(state, "_append", stopping)
        with pytest.raises(RuntimeError, match="lost"):
            state.add(_paths(spark, ["c/x.csv", "a/x.csv"]), "path", "two")
        assert state.report().collect() == []
    monkeypatch.setattr(state, "_append", append)
    touched = state.add(_paths(spark, ["c/x.csv", "a/x.csv"]), "path", "two")
    assert [tuple(x) for x in touched.collect()] == [("s3://b/r/tmp/x.parquet", 2, 3)]
    assert sorted(state.report().collect()) == sorted(touched.collect())


def test_empty_batches(spark, tmp_path):
    state = dr.TakenDestinations(spark, str(tmp_path / "taken"), "b", "r", buckets=2)
    assert state.report().collect() == []
    assert state.add(_paths(spark, []), "path", "none").collect() == []


def test_the_state_is_not_shuffled(spark, tmp_path):
    state = dr.TakenDestinations(spark, str(tmp_path / "taken"), "b", "r", buckets=4)
    for k in range(3):
        state.add(_paths(spark, [f"{k}/{i % 30}.csv" for i in range(100)]), "path", str(k))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = state.report()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
        known = state._committed(state._paths).select("path").distinct()
        batch = _paths(spark, ["x"]).repartition(4, "path")
        plan = batch.join(known.withColumn("known", F.lit(True)), "path", "left")._jdf.queryExecution()
        plan = plan.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
