"""Finishing a run: its result as records, its outcome in a log."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dataroute.operators.records import save_records, to_records
from dataroute.operators.resolve import (
    JSON_SERIALIZATION_ERROR,
    NONE,
    READ_ERROR,
    READ_FAILURES,
    Resolved,
    resolve,
    shape,
    temp_views,
)
from dataroute.sources.marks import Taken, add_mark, read_marks
from dataroute.sources.paths import literal_path
from dataroute.sources.save import save

OUTCOME_SCHEMA = (
    "name string, status string, result_source string, locator string, "
    "n_rows bigint, n_cols int, error_message string"
)
SUCCESS = "success"
ERROR = "error"
#: Marks of compactions beside a log's days, what the names of their partitions begin with,
#: and bytes of a log that one task writes.
COMPACTIONS, COMPACTED, COMPACTED_BYTES = "_compactions", "compacted-", 128 << 20
#: Tables that an audit counts at the same time.
AUDIT_JOBS = 8


def audit(spark: SparkSession, sources: Mapping[str, Mapping]) -> DataFrame:
    """One outcome row per source, given as the keyword arguments of ``resolve``.

    Each source is counted by a job of its own, so that one unreadable table
    becomes its own ``read_error`` and not the failure of the whole audit; a few
    of these jobs run side by side. Only the counts come back to the driver.
    """

    def count(item: tuple[str, Mapping]) -> tuple:
        name, where = item
        found = resolve(spark, **where)
        if found.df is None:
            return _outcome(name, found)
        try:
            return _outcome(name, found, shape(found.df).first().n_rows)
        except READ_FAILURES as problem:
            return _failed(name, found, READ_ERROR, problem)

    with ThreadPoolExecutor(AUDIT_JOBS) as pool:
        outcomes = list(pool.map(count, sources.items()))
    return spark.createDataFrame(outcomes, OUTCOME_SCHEMA)


def finish_run(
    spark: SparkSession,
    name: str,
    records_path: str,
    log_path: str | None = None,
    **where,
) -> DataFrame:
    """Resolve a run's result, write it as JSON records and report the outcome.

    ``where`` holds the arguments of ``resolve``. Rows are counted while they are
    written, so the result is read once. The outcome row is also appended to
    ``log_path`` when that is given. A records path that is taken raises, after
    the run's error row is in the log.
    """
    outcome = _logged(spark, spark, name, records_path, log_path, where)
    return _reported(spark, outcome, log_path)


def run_job(
    spark: SparkSession,
    name: str,
    job: Callable[[SparkSession, str], DataFrame | None],
    run_dir: str,
    log_path: str | None = None,
) -> DataFrame:
    """Run ``job(spark, output_dir)``, find its result, publish it, report.

    The job may save ``result.parquet`` (or another table) in ``output_dir``,
    create one temporary view, or return a DataFrame; ``resolve`` picks in this
    order and the records go to ``{run_dir}/records``. Give every run a folder of
    its own, as ``unique_location`` does, and no result of an earlier run can be
    taken for this one's. A job that raises has an ``error`` outcome and no
    result, whatever it left behind.

    The job is given a session of its own, with the settings of ``spark`` and no
    temporary views, so runs at the same time do not see each other's. It builds
    its tables from that session.
    """
    output_dir = f"{run_dir.rstrip('/')}/output"
    session = _own_session(spark)
    try:
        returned = job(session, output_dir)
    except Exception as problem:  # noqa: BLE001 - any failure is the job's outcome
        failed = Resolved(None, NONE, None, f"{type(problem).__name__}: {problem}")
        return _reported(spark, _outcome(name, failed), log_path)
    where = {
        "output_dir": output_dir,
        "new_views": temp_views(session),
        "df": returned if isinstance(returned, DataFrame) else None,
    }
    records_path = f"{run_dir.rstrip('/')}/records"
    outcome = _logged(spark, session, name, records_path, log_path, where)
    return _reported(spark, outcome, log_path)


def append_outcomes(outcomes: DataFrame, log_path: str) -> None:
    """Add outcome rows to the log table at ``log_path``.

    Every append is a ``day=.../run=...`` partition of its own: runs that finish
    at the same moment share no output folder. ``read_log`` reads them all, and
    ``compact_log`` makes one partition of a day's.
    """
    run_id = str(uuid.uuid4())
    day = datetime.datetime.now(datetime.timezone.utc).date()
    rows = outcomes.withColumn("run_id", F.lit(run_id))
    save(rows, f"{log_path.rstrip('/')}/day={day}/run={run_id}")


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """All outcome rows of a log, each once, with ``run_id`` and ``day``.

    A row counts in its own run's folder, or in that of a compaction that has its mark.
    Folders that a compaction has replaced are pruned as partitions: nothing is shuffled.
    """
    root = log_path.rstrip("/")
    marks = read_marks(spark, f"{root}/{COMPACTIONS}")
    replaced = [x for mark in marks for x in mark["replaced"]]
    rows = spark.read.parquet(literal_path(root))
    counts = F.col("run") == F.col("run_id")
    if marks:
        counts = (counts | F.col("run").isin([x["run"] for x in marks])) & ~F.col("run").isin(replaced)
    return rows.filter(counts).drop("run")


def compact_log(spark: SparkSession, log_path: str, day: str) -> None:
    """Make one partition of the ones that a day's runs have left in the log.

    The new one counts from the moment a mark says so and names what it replaces; only then
    do the old ones go. Of two compactions at the same time one gets the mark and the other
    leaves everything as it is. Stopped halfway, it can be run again.
    """
    root = log_path.rstrip("/")
    folder = f"{root}/day={day}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = read_marks(spark, f"{root}/{COMPACTIONS}")
    counted = {x["run"] for x in marks}
    gone = {x for mark in marks for x in mark["replaced"]}
    there = {x.getPath().getName().removeprefix("run="): x.getPath() for x in files.listStatus(path)}
    old = [x for x in there if x not in gone and (not x.startswith(COMPACTED) or x in counted)]
    if len(old) > 1:
        size = sum(files.getContentSummary(there[x]).getLength() for x in old)
        rows = spark.read.parquet(*[literal_path(there[x].toString()) for x in old])
        run = f"{COMPACTED}{uuid.uuid4()}"
        save(rows.coalesce(1 + size // COMPACTED_BYTES), f"{folder}/run={run}")
        try:
            add_mark(spark, f"{root}/{COMPACTIONS}", {"day": day, "run": run, "replaced": old}, len(marks))
        except Taken:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/run={run}"), True)
            return
        gone |= set(old)
    for name in gone & there.keys():
        files.delete(there[name], True)


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and temporary views of its own."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def _logged(
    spark: SparkSession,
    session: SparkSession,
    name: str,
    records_path: str,
    log_path: str | None,
    where: Mapping,
) -> tuple:
    """Publish in ``session``; what is raised is in the log first."""
    found = resolve(session, **where)
    try:
        return _publish(name, records_path, found)
    except AnalysisException as problem:
        _reported(spark, _failed(name, found, found.source, problem), log_path)
        raise


def _reported(spark: SparkSession, outcome: tuple, log_path: str | None) -> DataFrame:
    reported = spark.createDataFrame([outcome], OUTCOME_SCHEMA)
    if log_path is not None:
        append_outcomes(reported, log_path)
    return reported


def _publish(name: str, records_path: str, found: Resolved) -> tuple:
    if found.df is None:
        return _outcome(name, found)
    counted = Observation()
    rows = found.df.observe(counted, F.count(F.lit(1)).alias("n_rows"))
    try:
        to_records(rows)
    except (AnalysisException, ValueError) as problem:
        return _failed(name, found, JSON_SERIALIZATION_ERROR, problem)
    try:
        save_records(rows, records_path)
    except AnalysisException:
        raise  # the target is at fault, say because it exists; not this result
    except READ_FAILURES as problem:
        label = JSON_SERIALIZATION_ERROR if _is_readable(found.df) else READ_ERROR
        return _failed(name, found, label, problem)
    return _outcome(name, found, counted.get["n_rows"])


def _is_readable(df: DataFrame) -> bool:
    """Whether the rows themselves can be computed; asked only when a write has failed."""
    try:
        df.write.format("noop").mode("overwrite").save()
        return True
    except READ_FAILURES:
        return False


def _outcome(name: str, found: Resolved, n_rows: int | None = None) -> tuple:
    status = SUCCESS if found.error is None else ERROR
    n_cols = None if found.df is None else len(found.df.columns)
    return (
        name, status, found.source, found.locator, n_rows, n_cols, found.error
    )


def _failed(name: str, found: Resolved, label: str, problem: Exception) -> tuple:
    return (name, ERROR, label, found.locator, None, None, str(problem))
