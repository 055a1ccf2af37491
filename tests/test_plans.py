"""What the plans must and must not contain, batch and streaming."""

import pytest
from pyspark.sql import functions as F

import dataroute as dr
from dataroute.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

ROW_WISE = sorted(
    name for name in QUERIES if name[0] in "dfg" and name not in {"f8_unique_path", "flow_priority_orders"}
)
REPORTS = ["h1_collisions", "h1_collisions_orders", "h3_inventory", "h3_inventory_scripts"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"b8_replace_stale"}))
def test_no_python_workers(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "EvalPython" not in text and "InPandas" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_functions_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize("name", REPORTS)
def test_reports_combine_before_both_shuffles(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") == 2
    # Partial and final step around each shuffle; nothing else aggregates.
    assert text.count("HashAggregate") == 4


def test_plan_has_one_shuffle(spark):
    text = plan(QUERIES["h2_plan"](spark, SF_DIR))
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2


def test_regexes_run_once_per_row(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    inventory = plan(dr.literal_inventory(pages, "page_id", "html"))
    assert inventory.count("regexp_extract_all(html") == 1
    assert plan(dr.quoted_literals(pages, "html")).count("regexp_extract_all(html") == 1
    # Once for the pieces and once for the literals in them; calls are told from their pieces.
    rewritten = plan(pages.select(dr.rewrite_literals("html", "b", "r").alias("new")))
    assert rewritten.count("regexp_extract_all(html") == 2
    rewritten = plan(pages.select(dr.rewrite_calls("html", definitions=("b", "p")).alias("new")))
    assert rewritten.count("regexp_extract_all(html") == 1
    redirected = pages.select(dr.redirect_path("url", "b", "r").alias("destination"))
    assert plan(redirected).count("regexp_extract_all(url") == 1


def test_only_needed_columns_are_read(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan(
        dr.literal_inventory(pages, "page_id", "html")
    )
    assert "ReadSchema: struct<url:string>" in plan(dr.redirect_collisions(pages, "url", "b", "r"))
    assert "ReadSchema: struct<>" in plan(dr.shape(pages))


def test_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,1)]" in plan(
        QUERIES["d2_filter"](spark, SF_DIR)
    )


def test_preview_keeps_only_the_first_rows(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["c6_preview"](spark, SF_DIR))


def test_functions_on_a_stream(spark, tmp_path):
    """Path and text functions are stateless, so a stream takes them as they are."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    folder = str(tmp_path / "pages")
    dr.save(pages, folder)

    def routed(df):
        return df.select(
            "page_id",
            dr.base_name("url").alias("base"),
            dr.redirect_path("url", "b", "r").alias("destination"),
            F.md5(dr.rewrite_literals("html", "b", "r")).alias("html"),
        )

    stream = routed(spark.readStream.schema(pages.schema).parquet(folder))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    assert query.awaitTermination(120)
    got = dr.scan(spark, "parquet", str(tmp_path / "out"))
    expected = routed(pages)
    assert got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0


@pytest.fixture
def settings(spark):
    """Session settings for one test."""
    before = {}

    def change(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.set(key, value)


def test_hot_join_key_is_split(spark, settings, tmp_path):
    """A third of all orders belong to one customer; its partition is split."""
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="64KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
    )
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").repartition(8)
    hot = orders.withColumn(
        "custkey", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey"))
    )
    customers = spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
    joined = hot.join(customers.withColumnRenamed("c_custkey", "custkey"), "custkey")
    location = dr.save_unique(joined, str(tmp_path))
    assert dr.scan(spark, "parquet", location).count() == orders.count()
    joined.collect()
    assert "SortMergeJoin(skew=true)" in plan(joined)
