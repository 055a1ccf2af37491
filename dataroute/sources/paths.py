"""Paths as patterns, and paths as they are written.

Spark's readers expand ``*``, ``?``, ``[...]`` and ``{...}``; its writers do not.
"""

from __future__ import annotations

import re

_CHARACTERS = r"[{}\[\]*?\\]"


def literal_path(path: str) -> str:
    """``path`` for a read that takes it as it is written, not as a pattern."""
    return re.sub(_CHARACTERS, r"\\\g<0>", path)


def is_pattern(path: str) -> bool:
    """Whether a read of ``path`` may expand it."""
    return re.search(_CHARACTERS, re.sub(rf"\\{_CHARACTERS}", "", path)) is not None


def as_written(path: str) -> str:
    """The path that a ``literal_path`` stands for."""
    return re.sub(rf"\\({_CHARACTERS})", r"\1", path)
