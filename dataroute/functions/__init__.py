"""Native column functions over paths, texts and values."""

from dataroute.functions.paths import (
    RULES_BASENAME,
    RULES_FLEXIBLE,
    RULES_STRICT,
    base_name,
    base_name_by_rules,
    base_name_first_dot,
    file_slug,
    redirect_location,
    redirect_path,
    strip_extension,
    unique_location,
    unique_path,
)
from dataroute.functions.text import (
    called_literals,
    clip,
    quoted,
    rewrite_calls,
    rewrite_literals,
    unquoted,
)
from dataroute.functions.values import json_value, text_value

__all__ = [
    "RULES_BASENAME",
    "RULES_FLEXIBLE",
    "RULES_STRICT",
    "base_name",
    "base_name_by_rules",
    "base_name_first_dot",
    "called_literals",
    "clip",
    "file_slug",
    "json_value",
    "quoted",
    "redirect_location",
    "redirect_path",
    "rewrite_calls",
    "rewrite_literals",
    "strip_extension",
    "text_value",
    "unique_location",
    "unique_path",
    "unquoted",
]
