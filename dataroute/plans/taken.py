"""Which destinations are taken, over all batches of paths that ever came.

The state is two tables that only grow, each by as many rows as a batch has paths: counts
by path, and counts by destination. Both are bucketed by their key, so a batch meets the
paths of all earlier ones, and a report sums all destinations, without shuffling what is
there already; only the batch is.

A batch counts once it is committed, by a file written last. A batch that failed halfway
can be added again: rows of an attempt without a commit are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataroute.functions.paths import redirect_path
from dataroute.sources.paths import literal_path

#: Buckets of a new state: tasks that a report has, and files that a batch adds to each table.
BUCKETS = 64

_PATHS = ("path", "path STRING, n BIGINT, attempt STRING")
_DESTINATIONS = ("destination", "destination STRING, n_paths BIGINT, n_rows BIGINT, attempt STRING")


class TakenDestinations:
    """The destinations of a run, kept at ``location``; one batch is added at a time.

    ``buckets`` counts for a new state; one that is there keeps its number.
    """

    def __init__(self, spark: SparkSession, location: str, bucket: str, run_id: str, buckets: int = BUCKETS):
        self.spark, self.bucket, self.run_id = spark, bucket, run_id
        self.location = location.rstrip("/")
        self._files, there = self._listed()
        self.buckets = next((int(x.rpartition("-")[2]) for x in there if x.startswith("paths-")), buckets)
        self._paths = self._table("paths", *_PATHS)
        self._destinations = self._table("destinations", *_DESTINATIONS)

    def add(self, df: DataFrame, path_col: str, batch: str) -> DataFrame:
        """Count the paths of a batch; returns ``report`` for the destinations it touches.

        Null paths do not count. A batch that is committed already raises ``ValueError``.
        """
        if not self._commits().filter(F.col("batch") == batch).isEmpty():
            raise ValueError(f"batch {batch!r} has been added before")
        attempt = str(uuid.uuid4())
        own = (
            df.select(F.col(path_col).alias("path"))
            .filter(F.col("path").isNotNull())
            .groupBy("path")
            .agg(F.count(F.lit(1)).alias("n"))
            .repartition(self.buckets, "path")
            .withColumn("attempt", F.lit(attempt))
        )
        known = self._committed(self._paths).select("path").distinct()
        self._append(own, self._paths, "path")
        written = self.spark.table(self._paths).filter(F.col("attempt") == attempt)
        new = written.join(known.withColumn("known", F.lit(True)), "path", "left")
        changed = (
            new.groupBy(redirect_path("path", self.bucket, self.run_id).alias("destination"))
            .agg(F.count_if(F.col("known").isNull()).alias("n_paths"), F.sum("n").alias("n_rows"))
            .repartition(self.buckets, "destination")
            .withColumn("attempt", F.lit(attempt))
        )
        self._append(changed, self._destinations, "destination")
        commit = self.spark.createDataFrame([(batch, attempt)], "batch string, attempt string")
        commit.coalesce(1).write.parquet(f"{self.location}/commits/{attempt}")
        self.spark.catalog.refreshTable(self._paths)
        touched = self.spark.table(self._destinations).filter(F.col("attempt") == attempt).select("destination")
        return self.report().join(touched, "destination", "left_semi")

    def report(self) -> DataFrame:
        """``(destination, n_paths, n_rows)`` where several paths of all batches meet."""
        counted = self._committed(self._destinations).groupBy("destination")
        return counted.agg(F.sum("n_paths").alias("n_paths"), F.sum("n_rows").alias("n_rows")).filter("n_paths > 1")

    def _listed(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.location)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files, [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def _table(self, name: str, key: str, columns: str) -> str:
        """A name in the session's catalog for files that know nothing of it."""
        table = f"{name}_{uuid.uuid4().hex}"
        place = f"{self.location}/{name}-{self.buckets}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        return table

    def _append(self, rows: DataFrame, table: str, key: str) -> None:
        rows = rows.select(*self.spark.table(table).columns)
        rows.write.format("parquet").bucketBy(self.buckets, key).mode("append").saveAsTable(table)

    def _commits(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.location}/commits")
        if not self._files.exists(path):
            return self.spark.createDataFrame([], "batch string, attempt string")
        reader = self.spark.read.schema("batch string, attempt string").option("recursiveFileLookup", True)
        return reader.parquet(literal_path(f"{self.location}/commits"))

    def _committed(self, table: str) -> DataFrame:
        # One row per batch that ever came.
        return self.spark.table(table).join(F.broadcast(self._commits().select("attempt")), "attempt", "left_semi")
