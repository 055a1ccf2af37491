"""Scans and sinks."""

from dataroute.sources.paths import literal_path
from dataroute.sources.publish import published, release_versions, replace_table, scan_published
from dataroute.sources.save import save, save_redirected, save_unique
from dataroute.sources.scan import scan, scan_redirected
from dataroute.sources.schemas import SchemaConflict, merged_schema, noted_schema
from dataroute.sources.scratch import release_scratch, scratch_location

__all__ = [
    "SchemaConflict",
    "literal_path",
    "merged_schema",
    "noted_schema",
    "published",
    "release_scratch",
    "release_versions",
    "replace_table",
    "save",
    "save_redirected",
    "save_unique",
    "scan",
    "scan_published",
    "scan_redirected",
    "scratch_location",
]
