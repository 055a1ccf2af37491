"""Table operators: literals, records and result resolution."""

from dataroute.operators.joins import hot_keys, join_hot, spread
from dataroute.operators.literals import call_literals, quoted_literals
from dataroute.operators.records import (
    preview,
    save_records,
    stringify,
    to_records,
)
from dataroute.operators.resolve import (
    Resolved,
    new_views,
    resolve,
    shape,
    temp_views,
)

__all__ = [
    "Resolved",
    "call_literals",
    "hot_keys",
    "join_hot",
    "new_views",
    "preview",
    "quoted_literals",
    "resolve",
    "save_records",
    "shape",
    "spread",
    "stringify",
    "temp_views",
    "to_records",
]
