"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once per application.

    Functions that run in tasks are pickled by reference, and a cluster's machines need
    not have this package installed. Spark fetches the archive from the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="dataroute-package-")
    archive = shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
    # Executors that start later fetch it too, so it stays as long as the driver runs.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
