"""Tables that are replaced whole or not at all.

An overwrite deletes the former table before it has written the new one, so a job that dies
leaves neither. Here each version has a folder of its own, and a numbered mark written last
says which one counts: until then readers have the former version, and readers that have
begun keep the one they began with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dataroute.sources.marks import Taken, add_mark, read_marks
from dataroute.sources.paths import literal_path
from dataroute.sources.save import save
from dataroute.sources.scan import scan

MARKS, VERSIONS = "_marks", "versions"


def replace_table(df: DataFrame, location: str, fmt: str = "parquet", **options) -> str:
    """Make ``df`` the table at ``location`` and return its version's folder.

    The table can be made from its own former version. Of replacements at the same time all
    get a version, and the one that is marked last counts.
    """
    root = location.rstrip("/")
    version = f"{root}/{VERSIONS}/{uuid.uuid4()}"
    save(df, version, fmt, **options)
    while True:
        try:
            marks = read_marks(df.sparkSession, f"{root}/{MARKS}")
            add_mark(df.sparkSession, f"{root}/{MARKS}", {"version": version, "format": fmt}, len(marks))
            return version
        except Taken:
            continue


def published(spark: SparkSession, location: str) -> str | None:
    """The folder of the version that counts; null if there is none yet."""
    marks = read_marks(spark, f"{location.rstrip('/')}/{MARKS}")
    return marks[-1]["version"] if marks else None


def scan_published(spark: SparkSession, location: str, **options) -> DataFrame:
    """The version of the table at ``location`` that counts now."""
    marks = read_marks(spark, f"{location.rstrip('/')}/{MARKS}")
    if not marks:
        raise FileNotFoundError(f"nothing has been published at {location!r}")
    return scan(spark, marks[-1]["format"], literal_path(marks[-1]["version"]), **options)


def release_versions(spark: SparkSession, location: str) -> int:
    """Delete all versions but the one that counts and return their number.

    For a time when no replacement and no reader of a former version is running.
    """
    root = location.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{VERSIONS}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = published(spark, root)
    if kept is None or not files.exists(path):
        return 0
    name = kept.rpartition("/")[2]
    old = [x.getPath() for x in files.listStatus(path) if x.getPath().getName() != name]
    for version in old:
        files.delete(version, True)
    return len(old)
