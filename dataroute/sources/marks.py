"""Numbered marks in a folder: small files that appear whole and never change.

A mark is written aside and renamed to the next number, which only one writer gets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Taken(Exception):
    """Another writer has made a mark since the marks were read."""


def read_marks(spark: SparkSession, folder: str) -> list:
    """What the marks say, oldest first."""
    path, files = _resolved(spark, folder)
    if not files.exists(path):
        return []
    found = sorted(x.getPath().getName() for x in files.listStatus(path))
    return [json.loads(_content(spark, files, f"{folder}/{name}")) for name in found if name.isdigit()]


def add_mark(spark: SparkSession, folder: str, content, known: int) -> None:
    """Add a mark to ``known`` ones; raises ``Taken`` if there is one more by now."""
    path, files = _resolved(spark, folder)
    aside, _ = _resolved(spark, f"{folder}/_{uuid.uuid4()}")
    stream = files.create(aside, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(_resolved(spark, f"{folder}/{known:010d}")[0]), options)
    except Exception as problem:
        files.delete(aside, False)
        if "FileAlreadyExists" in str(problem):
            raise Taken(folder) from problem
        raise


def _resolved(spark: SparkSession, location: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _content(spark: SparkSession, files, location: str) -> str:
    path, _ = _resolved(spark, location)
    stream = files.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
