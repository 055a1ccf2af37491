"""A place for intermediate tables that every executor can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from dataroute.functions.paths import unique_location

SHARED_FOLDER_SETTING = "spark.checkpoint.dir"

_local_folder: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def scratch_location(spark: SparkSession, label: str) -> str:
    """A new location below the shared folder that the cluster names.

    Without that setting a local session uses one temporary folder of its own; on a
    cluster that would be a different folder on every machine, so it is refused. What
    is written to the location goes when the application ends, or with
    ``release_scratch`` before.
    """
    shared = spark.conf.get(SHARED_FOLDER_SETTING, None)
    if shared is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(
                f"set {SHARED_FOLDER_SETTING} to a folder all executors share"
            )
        application = _application(spark)
        if application not in _local_folder:
            _local_folder[application] = tempfile.mkdtemp(prefix="dataroute-")
            _delete_at_end(spark, _local_folder[application])
        shared = _local_folder[application]
    location = unique_location(f"{shared.rstrip('/')}/{label}", suffix="")
    _made.setdefault(_application(spark), []).append(location)
    _delete_at_end(spark, location)
    return location


def release_scratch(spark: SparkSession) -> None:
    """Delete what this session's scratch locations hold. Nothing may read them any more."""
    for location in _made.pop(_application(spark), []):
        path = _path(spark, location)
        _file_system(spark, path).delete(path, True)


def _delete_at_end(spark: SparkSession, location: str) -> None:
    """Let the file system delete the location when it is closed, at the latest."""
    path = _path(spark, location)
    _file_system(spark, path).deleteOnExit(path)


def _application(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def _path(spark: SparkSession, location: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)


def _file_system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
