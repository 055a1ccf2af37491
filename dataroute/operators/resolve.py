"""Find the result of a run: saved Parquet, then a new view, then a DataFrame."""

from __future__ import annotations

from collections.abc import Collection
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataroute.sources.paths import literal_path

# --- Fixed values: result labels and the name of a run's output ---------------
PARQUET = "parquet"
VIEW = "view"
DIRECT_DATAFRAME = "direct_dataframe"
NONE = "none"
READ_ERROR = "read_error"
JSON_SERIALIZATION_ERROR = "json_serialization_error"
RESULT_NAME = "result.parquet"
PART_FILE_PREFIX = "part-"
HIDDEN = "._"
# ------------------------------------------------------------------------------

# A table that cannot be read shows up as either, depending on who notices first.
READ_FAILURES = (PySparkException, Py4JJavaError)


class Resolved(NamedTuple):
    """A result, where it came from, and the error that kept it from loading."""

    df: DataFrame | None
    source: str
    locator: str | None
    error: str | None = None


def resolve(
    spark: SparkSession,
    output_dir: str | None = None,
    new_views: Collection[str] = (),
    df: DataFrame | None = None,
    result_name: str = RESULT_NAME,
) -> Resolved:
    """The first source that is present; none of them is read beyond its schema.

    1. In ``output_dir``: ``result_name`` if it is there, else the first entry
       by name. When that is a part file or a ``key=value`` folder, the folder
       itself is the table, with every part and partition.
    2. ``new_views``, when it names exactly one view.
    3. ``df``.

    A source that is present but unreadable is a ``read_error``: later sources
    are not tried, so a broken output never passes for an older result.
    """
    if output_dir is not None:
        found = _from_output(spark, output_dir.rstrip("/"), result_name)
        if found is not None:
            return found
    if len(new_views) == 1:
        (name,) = new_views
        try:
            return Resolved(spark.table(name), VIEW, name)
        except READ_FAILURES as problem:
            return Resolved(None, READ_ERROR, name, str(problem))
    if df is not None:
        return Resolved(df, DIRECT_DATAFRAME, None)
    return Resolved(None, NONE, None)


def temp_views(spark: SparkSession) -> set[str]:
    """Names of the session's temporary views, to be taken before a run."""
    # One command over views; the catalog's tables are not looked up.
    views = spark.sql("SHOW VIEWS").filter("isTemporary").select("viewName")
    return {view.viewName for view in views.collect()}


def new_views(spark: SparkSession, before: Collection[str]) -> set[str]:
    """Temporary views that were not there before; a replaced view is not new."""
    return temp_views(spark) - set(before)


def shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_cols)``; no column is read to count the rows."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols")
    )


def _from_output(
    spark: SparkSession, output_dir: str, result_name: str
) -> Resolved | None:
    path = f"{output_dir}/{result_name}"
    try:
        return Resolved(spark.read.parquet(literal_path(path)), PARQUET, path)
    except READ_FAILURES as problem:
        if not _is_missing(problem):
            return Resolved(None, READ_ERROR, path, str(problem))
    try:
        path = _first_entry(spark, output_dir)
        if path is None:
            return None
        return Resolved(spark.read.parquet(literal_path(path)), PARQUET, path)
    except READ_FAILURES as problem:
        if _is_missing(problem):
            return None
        return Resolved(None, READ_ERROR, path, str(problem))


def _first_entry(spark: SparkSession, folder: str) -> str | None:
    """First visible entry of a folder by name, on any file system Spark knows.

    One listing of this level only, of which one entry at a time is looked at: a
    folder that is partitioned a million ways is not held in the driver.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    entries = files.listStatusIterator(path)
    first, is_partition = None, False
    while entries.hasNext():
        entry = entries.next()
        name = entry.getPath().getName()
        if name[0] not in HIDDEN and (first is None or name < first):
            first, is_partition = name, "=" in name and entry.isDirectory()
    if first is None:
        return None
    is_table = is_partition or first.startswith(PART_FILE_PREFIX)
    return folder if is_table else f"{folder}/{first}"


def _is_missing(problem: Exception) -> bool:
    return (
        isinstance(problem, AnalysisException)
        and problem.getCondition() == "PATH_NOT_FOUND"
    )
