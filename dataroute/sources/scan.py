"""Table scans: Spark's built-in file formats and named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from dataroute.functions.paths import redirect_location
from dataroute.sources.paths import literal_path
from dataroute.sources.schemas import noted_schema

VIEW = "table"


def scan(
    spark: SparkSession,
    fmt: str | None,
    path: str,
    schema: StructType | str | None = None,
    **options,
) -> DataFrame:
    """Read ``path`` as ``fmt``; ``None`` is the session's default format.

    ``fmt="table"`` reads the view or table named by ``path``. Give CSV and JSON
    a schema whenever it is known: JSON inference is one more pass over all the
    data, and CSV without one has string columns ``_c0, _c1, ...``.

    A Parquet table that ``save`` has appended other columns or wider types to is read
    whole: columns that a file lacks are null, narrower values are widened. A table without
    such appends costs one look for a note more.
    """
    if fmt == VIEW:
        return spark.table(path)
    reader = spark.read.options(**options)
    if schema is None and (fmt or spark.conf.get("spark.sql.sources.default")) == "parquet":
        schema = noted_schema(spark, path)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path, format=fmt)


def scan_redirected(
    spark: SparkSession, path: str, root: str, run_id: str
) -> DataFrame:
    """Read what ``save_redirected`` stored for ``path`` in this run."""
    return scan(spark, "parquet", literal_path(redirect_location(path, root, run_id)))
