"""Scans, sinks, result resolution and the run log."""

import os
import shutil
import subprocess
import sys
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import dataroute as dr

PEOPLE = [(1, "Alice"), (2, "Bob"), (3, "Charlie")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, ["id", "name"])


@pytest.fixture
def view(spark):
    """Names of temporary views, dropped after the test."""
    names = []

    def make(df, name=None):
        names.append(name or f"view_{uuid.uuid4().hex}")
        df.createOrReplaceTempView(names[-1])
        return names[-1]

    yield make
    for name in names:
        spark.catalog.dropTempView(name)


def test_save_modes(spark, people, tmp_path):
    path = str(tmp_path / "t")
    for mode, expected in [("overwrite", 3), ("append", 6), ("ignore", 6)]:
        dr.save(people, path, mode=mode)
        assert dr.scan(spark, "parquet", path).count() == expected
    with pytest.raises(AnalysisException) as problem:
        dr.save(people, path)
    assert problem.value.getCondition() == "PATH_ALREADY_EXISTS"
    dr.save(people, path, mode="overwrite")
    assert dr.scan(spark, None, path).count() == 3


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_formats(spark, people, tmp_path, fmt):
    path = str(tmp_path / fmt)
    dr.save(people, path, fmt)
    back = dr.scan(spark, fmt, path, schema=people.schema)
    assert sorted(map(tuple, back.collect())) == PEOPLE


def test_csv_options_and_strings(spark, people, tmp_path):
    path = str(tmp_path / "csv")
    dr.save(people, path, "csv", header=True)
    assert dr.scan(spark, "csv", path, header=True).columns == ["id", "name"]
    plain = dr.scan(spark, "csv", path)
    assert plain.columns == ["_c0", "_c1"]
    assert {kind for _, kind in plain.dtypes} == {"string"}


def test_redirected_writer_and_reader_meet(spark, people, tmp_path):
    root = str(tmp_path)
    location = dr.save_redirected(people, "/any/where/people.v1.csv", root, "run")
    assert location == f"{root}/run/tmp/people.parquet"
    # Another spelling of the same name reaches the same table.
    assert dr.scan_redirected(spark, "s3://b/people.json", root, "run").count() == 3
    with pytest.raises(AnalysisException):
        dr.save_redirected(people, "other/people.parquet", root, "run")
    with pytest.raises(ValueError):
        dr.save_redirected(people, "x.csv", root, "")


def test_unique_writes_never_meet(spark, people, tmp_path):
    paths = {dr.save_unique(people, str(tmp_path), suffix) for suffix in ["/", "/", ".parquet"]}
    assert len(paths) == 3
    assert dr.scan(spark, "parquet", paths.pop()).count() == 3


def session_with(context, **settings):
    """A stand-in: the shared folder can only be set when a cluster starts."""
    named = {f"spark.{key}": value for key, value in settings.items()}
    conf = SimpleNamespace(get=lambda key, default=None: named.get(key, default))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_scratch_is_shared_or_local(spark, tmp_path):
    context = spark.sparkContext
    shared = f"file://{tmp_path}/folder/"
    cluster = session_with(context, **{"checkpoint.dir": shared, "master": "yarn"})
    assert dr.scratch_location(cluster, "x").startswith(f"{shared}x/")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        dr.scratch_location(session_with(context, master="yarn"), "x")
    assert dr.scratch_location(spark, "x") != dr.scratch_location(spark, "x")


def test_scratch_tables_go_with_the_session(tmp_path):
    """An application of its own, whose folders are gone when it has ended."""
    script = """
import dataroute as dr
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
early, late = (dr.scratch_location(spark, name) for name in ("early", "late"))
dr.save(spark.range(5), early)
dr.release_scratch(spark)
assert not os.path.exists(early)
late = dr.scratch_location(spark, "late")
dr.save(spark.range(5), late)
assert os.path.exists(late)
"""
    environment = os.environ | {"TMPDIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run(
        [sys.executable, "-c", "import os" + script], env=environment, capture_output=True, timeout=120
    )
    assert done.returncode == 0, done.stderr.decode()[-2000:]
    for _ in range(100):  # the JVM ends a moment after the script
        left = [x for x in os.listdir(tmp_path) if x.startswith("dataroute-")]
        if not left:
            break
        time.sleep(0.1)
    assert left == []


NAMES = ["/a/b*c.csv", "/a/bXc.csv", "part[1].csv", "{ws}.csv", "q?.csv", "back\\slash.csv"]


def test_redirected_names_are_no_patterns(spark, tmp_path):
    for n, name in enumerate(NAMES, 1):
        dr.save_redirected(spark.range(n), name, str(tmp_path), "run")
    for n, name in enumerate(NAMES, 1):
        assert dr.scan_redirected(spark, name, str(tmp_path), "run").count() == n
    with pytest.raises(ValueError, match="colon"):
        dr.save_redirected(spark.range(1), "C:\\w\\sys.ini", str(tmp_path), "run")


def test_output_folders_are_no_patterns(spark, people, tmp_path):
    dr.save(people, str(tmp_path / "aXb" / "result.parquet"))
    dr.save(people.limit(1), str(tmp_path / "a*b" / "result.parquet"))
    dr.save(people.limit(2), str(tmp_path / "a[1]" / "first"))
    assert dr.resolve(spark, str(tmp_path / "a*b")).df.count() == 1
    assert dr.resolve(spark, str(tmp_path / "a[1]")).df.count() == 2


@pytest.mark.parametrize("has_df", [True, False])
@pytest.mark.parametrize("has_view", [True, False])
@pytest.mark.parametrize("has_parquet", [True, False])
def test_priority(spark, people, view, tmp_path, has_parquet, has_view, has_df):
    output = str(tmp_path / "out")
    if has_parquet:
        dr.save(people, f"{output}/result.parquet")
    views = {view(people)} if has_view else set()
    found = dr.resolve(spark, output, views, people if has_df else None)
    present = [has_parquet, has_view, has_df, True]
    labels = ["parquet", "view", "direct_dataframe", "none"]
    assert found.source == labels[present.index(True)]
    assert (found.df is None) == (found.source == "none")
    locators = {"parquet": f"{output}/result.parquet", "view": next(iter(views), None)}
    assert found.locator == locators.get(found.source)


def test_views(spark, people, view):
    old = view(people)
    before = dr.temp_views(spark)
    assert old in before
    view(people, old)
    assert dr.new_views(spark, before) == set()
    first = view(people)
    assert dr.new_views(spark, before) == {first}
    second = view(people)
    both = dr.new_views(spark, before)
    assert both == {first, second}
    assert dr.resolve(spark, None, both, people).source == "direct_dataframe"
    assert dr.resolve(spark, None, both).source == "none"
    assert dr.resolve(spark, None, {"no_such_view"}, people).source == "read_error"


def test_output_fallback(spark, people, tmp_path):
    output = str(tmp_path / "out")
    assert dr.resolve(spark, output).source == "none"
    (tmp_path / "out").mkdir()
    assert dr.resolve(spark, output).source == "none"
    dr.save(people, f"{output}/b.parquet")
    dr.save(people.limit(1), f"{output}/a")
    dr.save(people.limit(2), f"{output}/a.parquet")
    found = dr.resolve(spark, f"{output}/")
    assert (found.locator, found.df.count()) == (f"{output}/a", 1)
    assert dr.resolve(spark, f"file://{output}").df.count() == 1
    dr.save(people, f"{output}/result.parquet")
    assert dr.resolve(spark, output).df.count() == 3


def test_output_written_into_the_folder_itself(spark, tmp_path):
    output = str(tmp_path / "out")
    dr.save(spark.range(100, numPartitions=4), output)
    found = dr.resolve(spark, output)
    assert (found.source, found.locator, found.df.count()) == ("parquet", output, 100)


def test_partitioned_output_is_one_table(spark, tmp_path):
    output = str(tmp_path / "out")
    spark.range(100).withColumn("k", F.col("id") % 4).write.partitionBy("k").parquet(output)
    found = dr.resolve(spark, output)
    assert (found.source, found.locator, found.df.count()) == ("parquet", output, 100)
    assert set(found.df.columns) == {"id", "k"}


def test_a_log_is_one_table(spark, people, tmp_path):
    log = str(tmp_path / "log")
    for name in ("one", "two", "three"):
        dr.finish_run(spark, name, str(tmp_path / name), log, df=people)
    # The log holds one folder per day, and these one folder per run.
    assert dr.resolve(spark, log).df.count() == 3
    (day,) = (tmp_path / "log").glob("day=*")
    for _ in range(2):
        dr.compact_log(spark, log, day.name.removeprefix("day="))
        assert len(list(day.glob("run=*"))) == 1
        assert {row.name for row in dr.read_log(spark, log).collect()} == {"one", "two", "three"}
    dr.finish_run(spark, "four", str(tmp_path / "four"), log, df=people)
    assert dr.read_log(spark, log).count() == 4
    # As if a compaction had stopped before its last step.
    twice = next(day.glob("run=*"))
    shutil.copytree(twice, day / "run=copy")
    assert dr.read_log(spark, log).count() == 4


def test_compactions_at_the_same_time_lose_and_repeat_nothing(spark, people, tmp_path, monkeypatch):
    from dataroute.plans import runs

    log = str(tmp_path / "log")
    for k in range(3):
        dr.finish_run(spark, f"run {k}", str(tmp_path / f"out{k}"), log, df=people)
    (day,) = (tmp_path / "log").glob("day=*")
    name = day.name.removeprefix("day=")
    names = {f"run {k}" for k in range(3)}

    def read():
        rows = [row.name for row in dr.read_log(spark, log).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    add = runs.add_mark

    def another_first(*mark):
        monkeypatch.setattr(runs, "add_mark", add)
        assert read() == names  # the new folder has no mark yet
        dr.finish_run(spark, "between", str(tmp_path / "between"), log, df=people)
        dr.compact_log(spark, log, name)
        assert read() == names | {"between"}
        add(*mark)

    monkeypatch.setattr(runs, "add_mark", another_first)
    dr.compact_log(spark, log, name)
    assert read() == names | {"between"}
    assert len(list(day.glob("run=*"))) == 1

    def dies(*mark):
        raise RuntimeError("lost")

    dr.finish_run(spark, "late", str(tmp_path / "late"), log, df=people)
    monkeypatch.setattr(runs, "add_mark", dies)
    with pytest.raises(RuntimeError, match="lost"):
        dr.compact_log(spark, log, name)
    monkeypatch.setattr(runs, "add_mark", add)
    assert read() == names | {"between", "late"}
    dr.compact_log(spark, log, name)
    assert read() == names | {"between", "late"}


def test_reading_a_log_shuffles_nothing(spark, people, tmp_path):
    log = str(tmp_path / "log")
    for k in range(3):
        dr.finish_run(spark, f"run {k}", str(tmp_path / f"out{k}"), log, df=people)
        (day,) = (tmp_path / "log").glob("day=*")
        dr.compact_log(spark, log, day.name.removeprefix("day="))
    plan = dr.read_log(spark, log)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_a_replacement_counts_whole_or_not_at_all(spark, people, tmp_path):
    where = str(tmp_path / "a table")
    assert dr.published(spark, where) is None
    with pytest.raises(FileNotFoundError):
        dr.scan_published(spark, where)
    dr.replace_table(people, where)
    before = dr.scan_published(spark, where)
    rows = sorted(before.collect())
    broken = spark.range(100).repartition(4).select(
        F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")
    )
    with pytest.raises(Exception, match="lost"):
        dr.replace_table(broken, where)
    assert sorted(dr.scan_published(spark, where).collect()) == rows
    # From its own former version, as a format of its own; a reader that has begun goes on.
    dr.replace_table(before.limit(1), where, "json")
    assert dr.scan_published(spark, where, schema=people.schema).count() == 1
    assert sorted(before.collect()) == rows
    assert dr.release_versions(spark, where) == 2
    assert dr.scan_published(spark, where, schema=people.schema).count() == 1


def test_marks_go_to_one_writer(spark, tmp_path):
    from dataroute.sources import marks

    folder = str(tmp_path / "marks")
    assert marks.read_marks(spark, folder) == []
    marks.add_mark(spark, folder, {"n": 0}, 0)
    with pytest.raises(marks.Taken):
        marks.add_mark(spark, folder, {"n": "late"}, 0)
    marks.add_mark(spark, folder, {"n": 1}, 1)
    assert [x["n"] for x in marks.read_marks(spark, folder)] == [0, 1]


def test_unreadable_output_is_no_reason_to_go_on(spark, people, tmp_path):
    (tmp_path / "result.parquet").write_text("this is not a table")
    found = dr.resolve(spark, str(tmp_path), (), people)
    assert found.source == "read_error"
    assert found.df is None and found.error


def test_shape(spark, people):
    assert tuple(dr.shape(people).first()) == (3, 2)
    assert dr.shape(people).columns == ["n_rows", "n_cols"]
    assert tuple(dr.shape(people.limit(0)).first()) == (0, 2)


def test_audit(spark, people, tmp_path):
    dr.save(people, str(tmp_path / "good" / "result.parquet"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "result.parquet").write_text("no table")
    failing = people.select(F.raise_error(F.lit("broken row")).alias("x")).filter("x is null")
    log = dr.audit(
        spark,
        {
            "good": {"output_dir": str(tmp_path / "good")},
            "bad": {"output_dir": str(tmp_path / "bad"), "df": people},
            "failing": {"df": failing},
            "none": {},
        },
    )
    rows = {row.name: row for row in log.collect()}
    assert log.columns == [
        "name", "status", "result_source", "locator", "n_rows", "n_cols", "error_message",
    ]
    assert tuple(rows["good"])[1:3] == ("success", "parquet")
    assert tuple(rows["good"])[4:] == (3, 2, None)
    assert (rows["bad"].status, rows["bad"].result_source) == ("error", "read_error")
    assert (rows["failing"].status, rows["failing"].result_source) == ("error", "read_error")
    assert "broken row" in rows["failing"].error_message
    assert tuple(rows["none"]) == ("none", "success", "none", None, None, None, None)


def test_finished_runs(spark, people, tmp_path):
    log = str(tmp_path / "log")
    repeated = people.select("id", F.col("name").alias("id"))
    failing = people.select(F.raise_error(F.lit("broken row")).alias("x"))
    cases = {
        "good": {"df": people},
        "no rows": {"df": people.filter("id > 5")},
        "folded": {"df": people.limit(0)},
        "repeated": {"df": repeated},
        "failing": {"df": failing},
        "nothing": {},
    }
    for name, where in cases.items():
        outcome = dr.finish_run(spark, name, str(tmp_path / name), log, **where)
        assert outcome.count() == 1
    rows = {row.name: row for row in dr.scan(spark, "parquet", log).collect()}
    assert {name: (row.status, row.result_source, row.n_rows) for name, row in rows.items()} == {
        "good": ("success", "direct_dataframe", 3),
        "no rows": ("success", "direct_dataframe", 0),
        "folded": ("success", "direct_dataframe", 0),
        "repeated": ("error", "json_serialization_error", None),
        "failing": ("error", "read_error", None),
        "nothing": ("success", "none", None),
    }
    assert dr.scan(spark, "text", str(tmp_path / "good")).count() == 3
    assert dr.scan(spark, "text", str(tmp_path / "folded")).count() == 0


def test_records_are_never_written_over(spark, people, tmp_path):
    dr.finish_run(spark, "first", str(tmp_path / "records"), df=people)
    with pytest.raises(AnalysisException):
        dr.finish_run(
            spark, "second", str(tmp_path / "records"), str(tmp_path / "log"), df=people.limit(1)
        )
    assert dr.scan(spark, "text", str(tmp_path / "records")).count() == 3
    row = dr.read_log(spark, str(tmp_path / "log")).first()
    assert (row.name, row.status, row.n_rows) == ("second", "error", None)
    assert "ALREADY_EXISTS" in row.error_message


def test_types_without_a_json_form_are_published_as_text(spark, tmp_path):
    df = spark.sql("select 1 as id, make_interval(1, 2) as span")
    outcome = dr.finish_run(spark, "spans", str(tmp_path / "records"), df=df).first()
    assert (outcome.status, outcome.n_rows, outcome.n_cols) == ("success", 1, 2)
    assert "1 years 2 months" in dr.scan(spark, "text", str(tmp_path / "records")).first().value


def test_types_are_decided_column_by_column(spark, tmp_path):
    df = spark.sql("select 1.5D as d, make_interval(1, 2) as span, cast('10:11:12' as time) as at")
    outcome = dr.finish_run(spark, "mixed", str(tmp_path / "records"), df=df).first()
    assert (outcome.status, outcome.n_rows) == ("success", 1)
    assert dr.scan(spark, "text", str(tmp_path / "records")).first().value == (
        '{"d":1.5,"span":"1 years 2 months","at":"10:11:12"}'
    )


def test_failures_of_serialisation_have_their_label(spark, tmp_path):
    # Two keys that are the same text.
    df = spark.sql("select map(X'ff', 1, X'fe', 2) as m")
    outcome = dr.finish_run(spark, "keys", str(tmp_path / "records"), df=df).first()
    assert (outcome.status, outcome.result_source) == ("error", "json_serialization_error")


def test_overlapping_jobs_publish_their_own_rows(spark, tmp_path):
    started, finished = threading.Event(), threading.Event()

    def slow(spark, output_dir):
        started.set()
        assert finished.wait(60)
        return spark.range(2)

    def fast(spark, output_dir):
        assert started.wait(60)
        spark.range(5).createOrReplaceTempView("fastview")

    def run(job):
        return dr.run_job(spark, job.__name__, job, str(tmp_path / job.__name__)).first()

    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(run, slow)
        second = pool.submit(run, fast).result(120)
        finished.set()
        first = first.result(120)
    assert (first.result_source, first.n_rows) == ("direct_dataframe", 2)
    assert (second.result_source, second.locator, second.n_rows) == ("view", "fastview", 5)
    assert "fastview" not in dr.temp_views(spark)


def test_a_job_has_the_settings_of_its_caller(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        seen = []
        dr.run_job(spark, "zone", lambda s, _: seen.append(s.conf.get("spark.sql.session.timeZone")), str(tmp_path))
        assert seen == ["Asia/Tokyo"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_jobs(spark, people, tmp_path):
    log = str(tmp_path / "log")
    name = f"view_{uuid.uuid4().hex}"

    def saves(spark, output_dir):
        dr.save(people, f"{output_dir}/result.parquet", mode="overwrite")

    def names_a_view(spark, output_dir):
        spark.createDataFrame(PEOPLE[:2], ["id", "name"]).createOrReplaceTempView(name)
        return people

    def returns(spark, output_dir):
        return people.limit(1)

    def returns_something_else(spark, output_dir):
        return 5

    def fails(spark, output_dir):
        saves(spark, output_dir)
        people.select("no_such_column")

    rows = {}
    for job in (saves, names_a_view, returns, returns_something_else, fails):
        run_dir = str(tmp_path / job.__name__)
        rows[job] = dr.run_job(spark, job.__name__, job, run_dir, log).first()
        assert (tmp_path / job.__name__ / "records").exists() == (rows[job].n_rows is not None)
    assert {job.__name__: (row.status, row.result_source, row.n_rows) for job, row in rows.items()} == {
        "saves": ("success", "parquet", 3),
        "names_a_view": ("success", "view", 2),
        "returns": ("success", "direct_dataframe", 1),
        "returns_something_else": ("success", "none", None),
        "fails": ("error", "none", None),
    }
    assert rows[saves].locator.endswith("/output/result.parquet")
    assert rows[names_a_view].locator == name
    assert "no_such_column" in rows[fails].error_message
    assert dr.scan(spark, "parquet", log).count() == 5
