"""Appends with other columns and types, and the scans that read them."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import dataroute as dr
from dataroute.sources import schemas


def test_appends_are_read_whole_every_time(spark, tmp_path):
    path = str(tmp_path / "a[1] table")
    first = spark.range(6).selectExpr("CAST(id AS INT) AS k", "id AS `gone soon`", "named_struct('x', id) AS s")
    dr.save(first.repartition(3), path)
    dr.save(spark.sql("SELECT 7000000000 AS K, 'new' AS added, named_struct('y', 1) AS s"), path, mode="append")
    dr.save(spark.sql("SELECT CAST(9 AS SMALLINT) AS k, DATE'2024-01-02' AS day"), path, mode="append")
    dr.save(spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:05' AS day, CAST(1 AS FLOAT) AS real"), path, mode="append")
    dr.save(spark.sql("SELECT 5 AS real"), path, mode="append")
    expected = [(k, k, (k, None), None, None, None) for k in range(6)]
    expected += [(7_000_000_000, None, (None, 1), "new", None, None)]
    expected += [(9, None, None, None, datetime.datetime(2024, 1, 2), None)]
    expected += [(None, None, None, None, datetime.datetime(2024, 1, 2, 3, 4, 5), 1.0), (None,) * 5 + (5.0,)]
    for _ in range(8):
        found = dr.scan(spark, "parquet", dr.literal_path(path))
        assert found.columns == ["k", "gone soon", "s", "added", "day", "real"]
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(
            str((k, g, None if s is None else T.Row(x=s[0], y=s[1]), *rest)) for k, g, s, *rest in expected
        )


def test_types_without_a_common_one_are_refused(spark, tmp_path):
    path = str(tmp_path / "table")
    dr.save(spark.range(3), path)
    for other in ("'x' AS id", "1.5D AS id", "array(1) AS id"):
        with pytest.raises(dr.SchemaConflict, match="'id'"):
            dr.save(spark.sql(f"SELECT {other}"), path, mode="append")
    assert sorted(x.id for x in dr.scan(spark, "parquet", path).collect()) == [0, 1, 2]
    assert not (tmp_path / "table" / "_schemas").exists()


def test_notes_of_appends_at_the_same_time_add_up(spark, tmp_path):
    path = str(tmp_path / "table")
    dr.save(spark.range(2), path)
    # Both have looked at the table before either has written.
    one = schemas.appendable(spark.sql("SELECT 5L AS id, 'a' AS a"), path)
    two = schemas.appendable(spark.sql("SELECT 6L AS id, 'b' AS b"), path)
    one.write.mode("append").parquet(path)
    two.write.mode("append").parquet(path)
    assert sorted(map(tuple, dr.scan(spark, "parquet", path).fillna("").collect())) == [
        (0, "", ""), (1, "", ""), (5, "a", ""), (6, "", "b"),
    ]


def test_overwriting_forgets_and_plain_tables_have_no_note(spark, tmp_path):
    path = str(tmp_path / "table")
    dr.save(spark.range(2), path, mode="append")
    assert dr.noted_schema(spark, path) is None
    dr.save(spark.sql("SELECT 'x' AS other"), path, mode="append")
    assert dr.noted_schema(spark, path).names == ["id", "other"]
    assert dr.noted_schema(spark, str(tmp_path / "*")) is None
    dr.save(spark.range(3), path, mode="overwrite")
    assert dr.noted_schema(spark, path) is None and dr.scan(spark, "parquet", path).columns == ["id"]


def test_filters_and_columns_still_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "table")
    dr.save(spark.range(9).withColumn("x", F.lit(1)), path)
    dr.save(spark.range(9), path, mode="append")
    plan = dr.scan(spark, "parquet", path).filter("id > 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan and "ReadSchema: struct<id:bigint>" in plan


SIMPLE = [
    T.ByteType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.DateType(),
    T.TimestampNTZType(), T.DecimalType(5, 2), T.DecimalType(9, 0), T.DecimalType(38, 0), T.BooleanType(),
]


@pytest.mark.parametrize("one, two", itertools.combinations(SIMPLE, 2), ids=str)
def test_wider_types_do_not_depend_on_order(one, two):
    def wider(*types):
        try:
            return schemas.wider_type(*types, "c")
        except dr.SchemaConflict:
            return None

    assert wider(one, two) == wider(two, one)
    nested = wider(T.ArrayType(one), T.ArrayType(two))
    assert (nested and nested.elementType) == wider(one, two)
