"""One query per operator, over whole tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import dataroute as dr
from dataroute.queries.inputs import (
    LINE_PATH,
    ORDER_PATH,
    ORDER_PATH_LINES,
    PART_JOB,
    PART_PATH,
    PART_SCRIPT,
    TABLES,
)

BUCKET = "b"
RUN_ID = "r1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dr.scan(spark, "parquet", f"{sf_dir}/{name}.parquet")


def part_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(PART_PATH).alias("path")
    )


def order_paths(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(ORDER_PATH).alias("path")
    )


def scripts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(PART_SCRIPT).alias("code")
    )


def jobs(spark, sf_dir):
    """Scripts that go to the scanner: a table of few bytes for much work, so dealt to all cores."""
    parts = dr.spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "parts")
    return parts.select("p_partkey", F.expr(PART_JOB).alias("code"))


def round_trip(name: str, fmt: str | None, schema: bool = True):
    """Save a table in a format and scan it back."""

    def query(spark, sf_dir):
        df = table(spark, sf_dir, name)
        path = dr.scratch_location(spark, name)
        dr.save(df, path, fmt or "parquet")
        return dr.scan(spark, fmt, path, schema=df.schema if schema else None)

    return query


# Scans and sinks


def a1_scan_parquet(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def a2_csv_strings(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    path = dr.scratch_location(spark, "orders")
    dr.save(df, path, "csv")
    return dr.scan(spark, "csv", path)


def a5_view_scan(spark, sf_dir):
    view = f"view_{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").createOrReplaceTempView(view)
    df = dr.scan(spark, "table", view)
    spark.catalog.dropTempView(view)
    return df


def b1_mode_overwrite(spark, sf_dir):
    path = dr.scratch_location(spark, "modes")
    dr.save(table(spark, sf_dir, "customer"), path)
    dr.save(table(spark, sf_dir, "supplier"), path, mode="overwrite")
    return dr.scan(spark, "parquet", path)


def b1_mode_append(spark, sf_dir):
    path = dr.scratch_location(spark, "modes")
    dr.save(table(spark, sf_dir, "customer"), path)
    dr.save(table(spark, sf_dir, "customer"), path, mode="append")
    return dr.scan(spark, "parquet", path)


def grown(change):
    """Customers, and the same appended with other columns or types."""

    def query(spark, sf_dir):
        path = dr.scratch_location(spark, "grown")
        customer = table(spark, sf_dir, "customer")
        dr.save(customer, path)
        dr.save(change(customer), path, mode="append")
        dr.save(customer.limit(0), path, mode="append")
        return dr.scan(spark, "parquet", path)

    return query


b1_append_more = grown(lambda df: df.withColumn("c_extra", F.char_length("c_name")))
b1_append_fewer = grown(lambda df: df.drop("c_acctbal"))
b1_append_wider = grown(lambda df: df.withColumn("c_nationkey", F.col("c_nationkey") + F.lit(5_000_000_000)))
b1_append_narrower = grown(lambda df: df.withColumn("c_custkey", F.col("c_custkey").cast("int")))


def b1_mode_ignore(spark, sf_dir):
    path = dr.scratch_location(spark, "modes")
    dr.save(table(spark, sf_dir, "customer"), path)
    dr.save(table(spark, sf_dir, "supplier"), path, mode="ignore")
    return dr.scan(spark, "parquet", path)


def b1_mode_error(spark, sf_dir):
    path = dr.scratch_location(spark, "modes")
    dr.save(table(spark, sf_dir, "customer"), path)
    outcome = "written"
    try:
        dr.save(table(spark, sf_dir, "supplier"), path)
    except AnalysisException as problem:
        outcome = problem.getCondition()
    return dr.scan(spark, "parquet", path).withColumn("outcome", F.lit(outcome))


def b5_records(spark, sf_dir):
    return dr.to_records(table(spark, sf_dir, "customer"))


def b5_records_text(spark, sf_dir):
    return dr.to_records(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    )


def b5_records_typed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = dr.scratch_location(spark, "records")
    dr.save_records(orders, path)
    parsed = F.from_json("value", orders.schema).alias("r")
    return dr.scan(spark, "text", path).select(parsed).select("r.*")


def b5_records_nested(spark, sf_dir):
    return dr.to_records(
        table(spark, sf_dir, "events").select(
            "event_id",
            F.col("ts").cast("date").alias("day"),
            F.struct("user_id", F.col("event_type").cast("binary").alias("kind")).alias(
                "who"
            ),
            F.array(F.lit(None), F.lit(float("nan"))).alias("gone"),
            F.create_map(F.lit("at"), F.col("ts")).alias("when"),
            F.array(F.struct("value", "props")).alias("measured"),
        )
    )


def b5_records_maps(spark, sf_dir):
    """Maps whose keys are days, times and bytes."""
    return dr.to_records(
        table(spark, sf_dir, "events").select(
            "event_id",
            F.create_map(F.col("ts").cast("date"), "user_id").alias("by_day"),
            F.create_map("ts", F.create_map(F.col("event_type").cast("binary"), F.col("ts").cast("date"))).alias(
                "by_time"
            ),
        )
    )


def b6_unique_sink(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    root = dr.scratch_location(spark, "unique")
    first, second = dr.save_unique(customers, root), dr.save_unique(customers, root)
    return (
        dr.scan(spark, "parquet", first)
        .withColumn("copy", F.lit(1))
        .unionByName(
            dr.scan(spark, "parquet", second).withColumn("copy", F.lit(2))
        )
    )


def b7_redirect_roundtrip(spark, sf_dir):
    root = dr.scratch_location(spark, "redirected")
    path = "/data/landing/orders.2024.csv"
    dr.save_redirected(table(spark, sf_dir, "orders"), path, root, RUN_ID)
    return dr.scan_redirected(spark, path, root, RUN_ID)


def b7_redirect_literal_names(spark, sf_dir):
    """Names that would be patterns of one another, each read back as its own table."""
    root = dr.scratch_location(spark, "redirected")
    names = {
        "/a/b*c.csv": "orders", "/a/bXc.csv": "customer",
        "part[1].csv": "supplier", "{ws}.csv": "nation",
    }
    for path, name in names.items():
        dr.save_redirected(table(spark, sf_dir, name), path, root, RUN_ID)
    found = [
        dr.shape(dr.scan_redirected(spark, path, root, RUN_ID)).withColumn("path", F.lit(path))
        for path in names
    ]
    return reduce(DataFrame.unionByName, found)


def b8_replace_stale(spark, sf_dir):
    """The result of a run holds nothing of the run before, at the same path."""
    output = dr.scratch_location(spark, "output")
    path = f"{output}/result.parquet"
    dr.save(table(spark, sf_dir, "lineitem"), path)
    dr.save(table(spark, sf_dir, "customer"), path, mode="overwrite")
    return dr.resolve(spark, output_dir=output).df


# Result resolution


def _labelled_shapes(found: dict[str, dr.Resolved]) -> DataFrame:
    """``(setup, source, n_rows, n_cols)`` of every setup that has a result."""
    shapes = [
        dr.shape(result.df).select(
            F.lit(setup).alias("setup"), F.lit(result.source).alias("source"), "*"
        )
        for setup, result in found.items()
    ]
    return reduce(DataFrame.unionByName, shapes)


def c1_resolve_order(spark, sf_dir):
    output = dr.scratch_location(spark, "output")
    dr.save(table(spark, sf_dir, "orders"), f"{output}/result.parquet")
    view, other = (f"view_{uuid.uuid4().hex}" for _ in range(2))
    table(spark, sf_dir, "customer").createOrReplaceTempView(view)
    table(spark, sf_dir, "region").createOrReplaceTempView(other)
    df = table(spark, sf_dir, "part")
    found = {
        "parquet": dr.resolve(spark, output),
        "parquet, view": dr.resolve(spark, output, {view}),
        "parquet, dataframe": dr.resolve(spark, output, (), df),
        "parquet, view, dataframe": dr.resolve(spark, output, {view}, df),
        "view": dr.resolve(spark, f"{output}-none", {view}),
        "view, dataframe": dr.resolve(spark, f"{output}-none", {view}, df),
        "two views, dataframe": dr.resolve(spark, None, {view, other}, df),
        "dataframe": dr.resolve(spark, f"{output}-none", (), df),
    }
    spark.catalog.dropTempView(view)
    spark.catalog.dropTempView(other)
    return _labelled_shapes(found)


def c2_new_views(spark, sf_dir):
    old, one, two = (f"view_{uuid.uuid4().hex}" for _ in range(3))
    parts = table(spark, sf_dir, "part")
    parts.createOrReplaceTempView(old)
    before = dr.temp_views(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView(old)
    found = {
        "replaced": dr.resolve(spark, None, dr.new_views(spark, before), parts)
    }
    table(spark, sf_dir, "customer").createOrReplaceTempView(one)
    found["one new"] = dr.resolve(spark, None, dr.new_views(spark, before), parts)
    table(spark, sf_dir, "supplier").createOrReplaceTempView(two)
    found["two new"] = dr.resolve(spark, None, dr.new_views(spark, before), parts)
    for view in (old, one, two):
        spark.catalog.dropTempView(view)
    return _labelled_shapes(found)


def c3_output_fallback(spark, sf_dir):
    output = dr.scratch_location(spark, "output")
    dr.save(table(spark, sf_dir, "customer"), f"{output}/b_second.parquet")
    dr.save(table(spark, sf_dir, "orders"), f"{output}/a_first.parquet")
    return dr.resolve(spark, output_dir=output).df


def c3_partitioned_output(spark, sf_dir):
    """An output folder that is partitioned is one table, partition column included."""
    output = dr.scratch_location(spark, "output")
    orders = table(spark, sf_dir, "orders")
    orders.write.partitionBy("o_orderstatus").parquet(output)
    return dr.resolve(spark, output_dir=output).df.select(orders.columns)


def c4_shape(spark, sf_dir):
    shapes = [
        dr.shape(table(spark, sf_dir, name)).withColumn("name", F.lit(name))
        for name in TABLES
    ]
    return reduce(DataFrame.unionByName, shapes)


def c5_audit(spark, sf_dir):
    sources = {
        name: {"output_dir": sf_dir, "result_name": f"{name}.parquet"}
        for name in TABLES
    }
    sources["nothing"] = {}
    return dr.audit(spark, sources).withColumn(
        "locator", F.substring_index("locator", "/", -1)
    )


def c5_run_log(spark, sf_dir):
    """Three runs, one without a result and one whose names repeat, and their log."""
    root = dr.scratch_location(spark, "runs")
    log = f"{root}/log"
    orders = table(spark, sf_dir, "orders")
    repeated = orders.select("o_orderkey", F.col("o_custkey").alias("o_orderkey"))
    dr.finish_run(spark, "good", f"{root}/good", log, df=orders)
    dr.finish_run(spark, "empty", f"{root}/empty", log)
    dr.finish_run(spark, "repeated", f"{root}/repeated", log, df=repeated)
    records = dr.scan(spark, "text", f"{root}/good")
    return (
        dr.read_log(spark, log)
        .select("name", "status", "result_source", "n_rows", "n_cols")
        .unionByName(
            dr.shape(records).select(
                F.lit("records").alias("name"),
                F.lit("success").alias("status"),
                F.lit("text").alias("result_source"),
                "*",
            )
        )
    )


def c5_taken_target(spark, sf_dir):
    """A run whose records path is taken raises, and its row is in the log."""
    root = dr.scratch_location(spark, "runs")
    log = f"{root}/log"
    dr.finish_run(spark, "first", f"{root}/records", log, df=table(spark, sf_dir, "orders"))
    try:
        dr.finish_run(spark, "second", f"{root}/records", log, df=table(spark, sf_dir, "customer"))
        raised = None
    except AnalysisException as problem:
        raised = problem.getCondition()
    return dr.read_log(spark, log).select(
        "name", "status", "result_source", "n_rows", F.lit(raised).alias("raised")
    )


def c5_run_job(spark, sf_dir):
    """One job of each kind; their outcomes and the sizes of their records."""
    root = dr.scratch_location(spark, "jobs")

    def saves(spark, output_dir):
        orders = table(spark, sf_dir, "orders")
        dr.save(orders.filter("o_orderkey > 1"), f"{output_dir}/result.parquet")
        return table(spark, sf_dir, "customer")

    def names_a_view(spark, output_dir):
        table(spark, sf_dir, "customer").createOrReplaceTempView("result")
        return table(spark, sf_dir, "orders")

    def returns(spark, output_dir):
        orders, customers = (table(spark, sf_dir, name) for name in ("orders", "customer"))
        return orders.join(customers, orders.o_custkey == customers.c_custkey)

    def fails(spark, output_dir):
        dr.save(table(spark, sf_dir, "customer"), f"{output_dir}/result.parquet")
        raise ValueError("the job fails after saving")

    outcomes, sizes = [], []
    for job in (saves, names_a_view, returns, fails):
        run_dir = dr.unique_location(root, suffix="")
        outcomes.append(dr.run_job(spark, job.__name__, job, run_dir))
        if job is not fails:
            records = dr.scan(spark, "text", f"{run_dir}/records")
            sizes.append(dr.shape(records).select(F.lit(job.__name__).alias("name"), "n_rows"))
    columns = ["name", "status", "result_source", "n_rows", "n_cols", "error_message"]
    records = reduce(DataFrame.unionByName, sizes).withColumnRenamed("n_rows", "n_records")
    return (
        reduce(DataFrame.unionByName, outcomes).select(*columns).join(records, "name", "left")
    )


def c6_preview(spark, sf_dir):
    return dr.preview(table(spark, sf_dir, "documents"), 20, order_by="doc_id")


# Projections, filters, joins


def d1_project(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


def d2_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey") > 1)


def d3_stringify(spark, sf_dir):
    return dr.stringify(table(spark, sf_dir, "orders"))


def d4_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", dr.clip("text").alias("clipped")
    )


def d5_keep_original(spark, sf_dir):
    return order_paths(spark, sf_dir).select(
        "o_orderkey",
        dr.redirect_path("path", BUCKET, RUN_ID).alias("kept"),
        dr.redirect_path("path", BUCKET, RUN_ID, keep_unmatched=False).alias("target"),
    )


def e1_join_using(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")
    return orders.join(customers, "custkey")


# Paths


def on_url(function):
    return lambda spark, sf_dir: table(spark, sf_dir, "pages").select(
        "page_id", function("url").alias("name")
    )


def on_path(function):
    return lambda spark, sf_dir: order_paths(spark, sf_dir).select(
        "o_orderkey", "path", function("path").alias("name")
    )


def on_lines(function):
    return lambda spark, sf_dir: table(spark, sf_dir, "orders").select(
        "o_orderkey", function(F.expr(ORDER_PATH_LINES)).alias("name")
    )


def on_part_path(function):
    return lambda spark, sf_dir: part_paths(spark, sf_dir).select(
        "p_partkey", "path", function("path").alias("name")
    )


def by_rules(rules):
    return lambda path: dr.base_name_by_rules(path, rules)


def f8_unique_path(spark, sf_dir):
    uuid_shape = r"^s3a://b/base/[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}/$"
    return (
        table(spark, sf_dir, "orders")
        .select(dr.unique_path(BUCKET, "base").alias("path"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("path").alias("n_distinct"),
            F.count_if(F.col("path").rlike(uuid_shape)).alias("n_well_formed"),
        )
    )


# Texts


def g1_literals(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return dr.quoted_literals(pages, "html")


def g1_literals_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dr.quoted_literals(documents, "text")


def g2_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", dr.rewrite_literals("html", BUCKET, RUN_ID).alias("html")
    )


def g2_rewrite_scripts(spark, sf_dir):
    return scripts(spark, sf_dir).select(
        "p_partkey", dr.rewrite_literals("code", BUCKET, RUN_ID).alias("code")
    )


def g3_calls(spark, sf_dir):
    return dr.call_literals(scripts(spark, sf_dir), "code")


def g4_rewrite_calls(spark, sf_dir):
    return scripts(spark, sf_dir).select(
        "p_partkey", dr.rewrite_calls("code").alias("code")
    )


def g4_rewrite_defined(spark, sf_dir):
    """Rewritten scripts with the definitions that they need."""
    return scripts(spark, sf_dir).select(
        "p_partkey", dr.rewrite_calls("code", definitions=("bucket", "base")).alias("code")
    )


def g3_calls_scanned(spark, sf_dir):
    """Calls that only a scanner tells from what looks like them."""
    return dr.call_literals(jobs(spark, sf_dir), "code")


def g4_rewrite_scanned(spark, sf_dir):
    return jobs(spark, sf_dir).select("p_partkey", dr.rewrite_calls("code").alias("code"))


# Jobs over whole tables


def accesses(spark, sf_dir):
    return dr.script_accesses(jobs(spark, sf_dir), "p_partkey", "code", BUCKET, RUN_ID)


def b7_script_accesses(spark, sf_dir):
    """What every script reads and writes, and where to."""
    return accesses(spark, sf_dir)


def b7_reads_without_writer(spark, sf_dir):
    return dr.reads_without_writer(accesses(spark, sf_dir))


def b7_contested_destinations(spark, sf_dir):
    return dr.contested_destinations(accesses(spark, sf_dir))


def b7_script_levels(spark, sf_dir):
    """In which order scripts can run, and which wait for each other."""
    ids = table(spark, sf_dir, "part").select("p_partkey")
    return dr.script_levels(ids, accesses(spark, sf_dir))


def h1_collisions(spark, sf_dir):
    return dr.redirect_collisions(part_paths(spark, sf_dir), "path", BUCKET, RUN_ID)


def h1_collisions_batches(spark, sf_dir):
    """The same report from a state that five batches have been added to."""
    state = dr.TakenDestinations(spark, dr.scratch_location(spark, "taken"), BUCKET, RUN_ID, buckets=8)
    orders = order_paths(spark, sf_dir)
    for k in range(5):
        state.add(orders.filter(F.col("o_orderkey") % 5 == k), "path", f"batch-{k}")
    return state.report()


def h1_collisions_orders(spark, sf_dir):
    return dr.redirect_collisions(order_paths(spark, sf_dir), "path", BUCKET, RUN_ID)


def b8_replace_published(spark, sf_dir):
    """A table that is made anew from its own former version, after a job that fails."""
    path = dr.scratch_location(spark, "published")
    dr.replace_table(table(spark, sf_dir, "customer"), path)
    broken = table(spark, sf_dir, "customer").withColumn("c_name", F.raise_error(F.lit("lost")).cast("string"))
    try:
        dr.replace_table(broken, path)
    except PySparkException:
        dr.replace_table(dr.scan_published(spark, path).filter("c_acctbal > 0"), path)
    return dr.scan_published(spark, path)


def h2_rows(spark, sf_dir):
    """The destination of every line's path; a third of all lines have the same path."""
    paths = F.expr("CASE l_orderkey % 3 WHEN 0 THEN 's3://lake/hot.csv' ELSE " + LINE_PATH + " END")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", paths.alias("path"))
    return dr.redirect_rows(lines, "path", BUCKET, RUN_ID)


def h2_plan(spark, sf_dir):
    return dr.redirect_plan(order_paths(spark, sf_dir), "path", BUCKET, RUN_ID)


def h3_inventory(spark, sf_dir):
    return dr.literal_inventory(table(spark, sf_dir, "pages"), "page_id", "html")


def h3_inventory_scripts(spark, sf_dir):
    return dr.literal_inventory(scripts(spark, sf_dir), "p_partkey", "code")


def flow_priority_orders(spark, sf_dir):
    """Scan, join, filter, project, save redirected, resolve, publish as records."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")
    result = (
        orders.join(customers, "custkey")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select("o_orderkey", "c_name", "o_orderdate", "o_totalprice")
    )
    root = dr.scratch_location(spark, "flow")
    dr.save_redirected(result, "/data/out/priority_orders.csv", root, RUN_ID)
    found = dr.resolve(spark, output_dir=f"{root}/{RUN_ID}/tmp")
    return dr.to_records(found.df)


QUERIES = {
    "a1_scan_parquet": a1_scan_parquet,
    "a2_csv_roundtrip": round_trip("customer", "csv"),
    "a2_csv_strings": a2_csv_strings,
    "a3_json_roundtrip": round_trip("pages", "json"),
    "a3_json_inferred": round_trip("labels", "json", schema=False),
    "a4_load_roundtrip": round_trip("part", None),
    "a5_view_scan": a5_view_scan,
    "b1_mode_overwrite": b1_mode_overwrite,
    "b1_mode_append": b1_mode_append,
    "b1_append_more": b1_append_more,
    "b1_append_fewer": b1_append_fewer,
    "b1_append_wider": b1_append_wider,
    "b1_append_narrower": b1_append_narrower,
    "b1_mode_ignore": b1_mode_ignore,
    "b1_mode_error": b1_mode_error,
    "b2_csv_save": round_trip("supplier", "csv"),
    "b3_json_save": round_trip("orders", "json"),
    "b4_format_roundtrip": round_trip("events", "orc"),
    "b5_records": b5_records,
    "b5_records_text": b5_records_text,
    "b5_records_typed": b5_records_typed,
    "b5_records_nested": b5_records_nested,
    "b5_records_maps": b5_records_maps,
    "b6_unique_sink": b6_unique_sink,
    "b7_redirect_roundtrip": b7_redirect_roundtrip,
    "b7_redirect_literal_names": b7_redirect_literal_names,
    "b8_replace_stale": b8_replace_stale,
    "c1_resolve_order": c1_resolve_order,
    "c2_new_views": c2_new_views,
    "c3_output_fallback": c3_output_fallback,
    "c3_partitioned_output": c3_partitioned_output,
    "c4_shape": c4_shape,
    "c5_audit": c5_audit,
    "c5_run_log": c5_run_log,
    "c5_run_job": c5_run_job,
    "c5_taken_target": c5_taken_target,
    "c6_preview": c6_preview,
    "d1_project": d1_project,
    "d2_filter": d2_filter,
    "d3_stringify": d3_stringify,
    "d4_clip": d4_clip,
    "d5_keep_original": d5_keep_original,
    "e1_join_using": e1_join_using,
    "f1_base_name": on_path(dr.base_name),
    "f1_base_name_url": on_url(dr.base_name),
    "f1_base_name_lines": on_lines(dr.base_name),
    "f2_base_name_first_dot": on_path(dr.base_name_first_dot),
    "f2_base_name_first_dot_url": on_url(dr.base_name_first_dot),
    "f3_file_slug": on_path(dr.file_slug),
    "f3_file_slug_url": on_url(dr.file_slug),
    "f3_file_slug_lines": on_lines(dr.file_slug),
    "f4_rules_strict": on_path(by_rules(dr.RULES_STRICT)),
    "f4_rules_flexible": on_path(by_rules(dr.RULES_FLEXIBLE)),
    "f4_rules_basename": on_path(by_rules(dr.RULES_BASENAME)),
    "f4_rules_custom": on_path(by_rules([r"/(c\d+)/\.", r"c(\d*5)\b"])),
    "f4_rules_bounded": on_path(
        lambda path: dr.base_name_by_rules(
            path, [r"(?:.*/)?(.+)\.json$", r"(?:.*/)?([^/]+)\.csv$", r"(?:.*/)?([a-z.]+)$"], bounded=True
        )
    ),
    "f5_strip_extension": on_path(dr.strip_extension),
    "f5_strip_extension_part": on_part_path(dr.strip_extension),
    "f7_redirect": on_part_path(
        lambda path: dr.redirect_path(path, BUCKET, RUN_ID)
    ),
    "f8_unique_path": f8_unique_path,
    "g1_literals": g1_literals,
    "g1_literals_documents": g1_literals_documents,
    "g2_rewrite": g2_rewrite,
    "g2_rewrite_scripts": g2_rewrite_scripts,
    "g3_calls": g3_calls,
    "g3_calls_scanned": g3_calls_scanned,
    "g4_rewrite_scanned": g4_rewrite_scanned,
    "b7_script_accesses": b7_script_accesses,
    "b7_reads_without_writer": b7_reads_without_writer,
    "b7_contested_destinations": b7_contested_destinations,
    "b7_script_levels": b7_script_levels,
    "g4_rewrite_calls": g4_rewrite_calls,
    "g4_rewrite_defined": g4_rewrite_defined,
    "h1_collisions": h1_collisions,
    "h1_collisions_batches": h1_collisions_batches,
    "h1_collisions_orders": h1_collisions_orders,
    "b8_replace_published": b8_replace_published,
    "h2_rows": h2_rows,
    "h2_plan": h2_plan,
    "h3_inventory": h3_inventory,
    "h3_inventory_scripts": h3_inventory_scripts,
    "flow_priority_orders": flow_priority_orders,
}
