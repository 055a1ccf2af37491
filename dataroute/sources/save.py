"""Table sinks: save modes, redirected and unique output locations.

Every sink is one distributed write; nothing is collected. Rewriting a path is
an ``overwrite`` save, so no folder is ever deleted by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from dataroute.functions.paths import redirect_location, unique_location
from dataroute.sources.schemas import appendable


def save(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", **options
) -> None:
    """Write ``df`` with a save mode: error (default), overwrite, append, ignore.

    An append to a Parquet table that has other columns or types writes the merged schema
    beside the data, and ``scan`` reads all rows under it; types without a common one raise
    ``SchemaConflict``. An overwrite starts anew.
    """
    if mode == "append" and fmt == "parquet":
        df = appendable(df, path)
    df.write.format(fmt).mode(mode).options(**options).save(path)


def save_unique(
    df: DataFrame, root: str, suffix: str = "/", fmt: str = "parquet", **options
) -> str:
    """Write ``df`` below ``root`` to a location of its own and return it."""
    location = unique_location(root, suffix)
    save(df, location, fmt, **options)
    return location


def save_redirected(
    df: DataFrame, path: str, root: str, run_id: str, mode: str = "error", **options
) -> str:
    """Write ``df``, meant for ``path``, to its place in this run and return that.

    The store is always Parquet, as the location's name says, whatever ``path``
    ends in. ``scan_redirected`` with the same path, root and run id reads it
    back. Directory and extension of ``path`` are not part of the location:
    ``redirect_collisions`` reports paths that would meet in one place, and the
    default mode refuses to write over another table. A base name with a colon is
    refused: no Hadoop file system can list it.
    """
    location = redirect_location(path, root, run_id)
    if ":" in location.rpartition("/")[2]:
        raise ValueError(f"a name with a colon cannot be read back: {location!r}")
    save(df, location, "parquet", mode, **options)
    return location
