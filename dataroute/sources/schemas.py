"""Schemas of tables that grew by appends with other columns or types.

Files of one folder can differ: a reader that takes the schema of one of them, as Spark's
does, loses the columns of the others or fails on their types, and which file it takes is
chance. So an append that changes a table's schema writes the merged one as a note beside
the data, in a folder that readers skip, and a scan reads all files under it.

A note is there before the rows that need it. Notes are only added, so appends at the same
time do not write over each other's; a scan merges what there is, oldest first.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataroute.sources.paths import as_written, is_pattern, literal_path

NOTES = "_schemas"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)
_NESTED = (T.StructType, T.ArrayType, T.MapType)


class SchemaConflict(ValueError):
    """A column has types of which neither holds all values of the other."""


def merged_schema(old: T.StructType, new: T.StructType, case_sensitive: bool = False) -> T.StructType:
    """The columns of ``old``, then those that only ``new`` has, each as the wider type."""
    key = str if case_sensitive else str.lower
    fields = {}
    for field in [*old.fields, *new.fields]:
        known = fields.get(key(field.name))
        if known is None:
            fields[key(field.name)] = T.StructField(field.name, field.dataType, True)
        else:
            known.dataType = wider_type(known.dataType, field.dataType, field.name, case_sensitive)
    return T.StructType(list(fields.values()))


def wider_type(one: T.DataType, two: T.DataType, name: str, case_sensitive: bool = False) -> T.DataType:
    """The type that holds all values of both; readers of Parquet can read either as it."""
    if one == two:
        return one
    kinds = {type(one), type(two)}
    if kinds <= {*_WHOLE}:
        return max(one, two, key=lambda x: _WHOLE.index(type(x)))
    if kinds <= {*_WHOLE[:3], *_REAL}:
        return T.DoubleType()
    if kinds == {T.DecimalType}:
        scale = max(one.scale, two.scale)
        precision = max(one.precision - one.scale, two.precision - two.scale) + scale
        if precision <= 38:
            return T.DecimalType(precision, scale)
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if kinds == {T.StructType}:
        return merged_schema(one, two, case_sensitive)
    if kinds == {T.ArrayType}:
        return T.ArrayType(wider_type(one.elementType, two.elementType, name, case_sensitive), True)
    if kinds == {T.MapType}:
        return T.MapType(
            wider_type(one.keyType, two.keyType, name, case_sensitive),
            wider_type(one.valueType, two.valueType, name, case_sensitive),
            True,
        )
    raise SchemaConflict(f"column {name!r}: {one.simpleString()} and {two.simpleString()} have no common type")


def noted_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """What the notes beside the table at ``path``, read as a pattern, say; null without one."""
    if is_pattern(path):
        return None
    notes = f"{as_written(path).rstrip('/')}/{NOTES}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(notes)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    rows = spark.read.text(literal_path(notes), wholetext=True, recursiveFileLookup=True)
    rows = rows.select("value", F.col("_metadata.file_path").alias("at")).orderBy("at").collect()
    schema = T.StructType([])
    for row in rows:
        schema = merged_schema(schema, T.StructType.fromJson(json.loads(row.value)), _case_sensitive(spark))
    return schema if rows else None


def appendable(df: DataFrame, path: str) -> DataFrame:
    """``df`` as it can be appended to the Parquet table at ``path``; notes its schema there.

    Without a table it stays as it is. A column that only one side has is null in the rows
    of the other; of two types the wider one counts, and narrower columns of ``df`` are cast
    to it. Types without a common one raise ``SchemaConflict`` and nothing is written.
    """
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder) or not files.listStatus(folder):
        return df
    noted = noted_schema(spark, literal_path(path))
    # Without a note all files' footers are read, by tasks, this once.
    old = noted or spark.read.option("mergeSchema", True).parquet(literal_path(path)).schema
    sensitive = _case_sensitive(spark)
    schema = merged_schema(old, df.schema, sensitive)
    if noted is None or schema != merged_schema(noted, T.StructType([]), sensitive):
        note = f"{path.rstrip('/')}/{NOTES}/{time.time_ns():020d}-{uuid.uuid4()}"
        line = spark.createDataFrame([(json.dumps(schema.jsonValue()),)], "value string")
        line.coalesce(1).write.text(note)
    key = str if sensitive else str.lower
    # Nested columns are written as they are: a reader fills and widens their parts.
    types = {key(x.name): x.dataType for x in schema.fields if not isinstance(x.dataType, _NESTED)}
    columns = {x.name: F.col(f"`{x.name.replace('`', '``')}`") for x in df.schema.fields}
    return df.select(
        *(x.cast(types[key(name)]).alias(name) if key(name) in types else x for name, x in columns.items())
    )


def _case_sensitive(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.caseSensitive", "false") == "true"
