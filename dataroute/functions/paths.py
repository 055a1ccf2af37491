"""Path functions: base names, destinations and unique destinations.

Every function is ``Column -> Column`` over a string column, built from native
expressions, row-wise and stateless, so it runs inside the scan stage of a table
of any size (or of a stream) without a shuffle. ``/`` is the only separator;
schemes, braces and backslashes are ordinary characters. Null, empty and
unmatched paths give null.

Base names are defined by unanchored regexes (the rule constants below).
Evaluated as they stand, those retry from every character of a path that does
not match, which is quadratic or worse and stalls a task on one long inline
``data:`` value. Here the everyday path is cut with substring functions, and only
names that start with a dot and paths with newlines go to a regex, which is
anchored and has disjoint character classes: the same results in time linear in
the path. The tests check both against the defining regexes.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataroute.functions._columns import as_column, first_match

# --- Fixed values: naming rules, rule sets, destination formats ---------------
RULE_FIRST_DOT = r"(?:.*/)?([^.]+)\.[^/]*$"
RULE_LAST_DOT = r"(?:.*/)?(.+)\.[^/]*$"
RULE_SPECIAL_NAME = r"(?:.*/)?(F8\.TBLR)\.[^/]*$"
RULE_PLAIN_NAME = r"(?:.*/)?([^/]+)$"

RULES_STRICT = [RULE_FIRST_DOT]
RULES_FLEXIBLE = [RULE_SPECIAL_NAME, RULE_LAST_DOT, RULE_PLAIN_NAME]
RULES_BASENAME = [RULE_PLAIN_NAME]

REDIRECT_SCHEME = "s3://"
REDIRECT_FOLDER = "tmp"
REDIRECT_SUFFIX = ".parquet"
UNIQUE_SCHEME = "s3a://"
# ------------------------------------------------------------------------------

# ``\A`` and this lookahead mean "start" and "very end" in Java and Python alike,
# so one constant serves the column functions and the driver-side helpers. The
# single-line dot is several times faster in Java than a class like ``[\s\S]``.
_ANY = r"(?s:.)"
_ALL = r"(?s:.*)"
_END = f"(?!{_ANY})"

# The last path part of a line up to its last dot; a part whose only dot leads
# it (``to/.config``) names the directory before it, slash included. Lines after
# the first matter only for paths that contain newlines.
_LAST_DOT = (
    r"(?:\A|\n)(?:[^\n]*/)?([^/\n]+|[^/\n]*/)\.[^/.\n]*(?:\n[^/]*)?" + _END
)

# The dot-free text that ends at the first dot after the last slash, cut at the
# last slash inside it that leaves something to name.
_FIRST_DOT = (
    rf"\A(?:(?:{_ALL}\.)?(?=[^.]*/)(?:[^.\n]*/)?|\.*)([^.]+)\.[^/]*" + _END
)

# The last path part, or the last directory with its slash when the path ends
# in one.
_LAST_PART = r"(?:\A|\n)(?:[^\n]*/)?([^/\n]+|[^/\n]*/)(?:\n[^/]*)?" + _END

# A stem with something other than leading dots in its last part, and an extension.
_EXTENSION = rf"\A({_ALL}[^/.]\.*)\.[^/.]*" + _END


def base_name(path: Column | str) -> Column:
    """File name without directory and without its last extension."""
    path = as_column(path)
    name = _last_part(path)
    found = _or_regex(_stem(name), path, _LAST_DOT, _from_last_line(path))
    return F.when(name.contains("."), found)


def base_name_first_dot(path: Column | str) -> Column:
    """File name up to its first dot."""
    path = as_column(path)
    name = _last_part(path)
    stem = F.substring_index(name, ".", 1)
    return F.when(name.contains("."), _or_regex(stem, path, _FIRST_DOT))


def file_slug(path: Column | str) -> Column:
    """Whole last path part, extension kept, with dots turned to underscores."""
    path = as_column(path)
    return _underscored(_or_regex(_last_part(path), path, _LAST_PART, _from_last_line(path)))


def strip_extension(name: Column | str) -> Column:
    """A name or path without its last extension; leading dots are no extension."""
    path = as_column(name)
    last = _last_part(path)
    has_extension = last.contains(".") & (F.ltrim(_stem(last), F.lit(".")) != "")
    return F.when(has_extension, _stem(path)).otherwise(path)


def base_name_by_rules(path: Column | str, rules: Sequence[str], bounded: bool = False) -> Column:
    """Name by the first rule whose group 1 is not empty, ``.`` or ``..``.

    The captured name loses one extension, and its remaining dots become
    underscores. Rules are regexes valid in both Python and Java; rules that do
    not compile or have no group are skipped, and no usable rule gives null.

    The ready rules take time in proportion to the path, and so do rules of the
    form ``(?:.*/)?(X+)end$`` on paths of one line, where ``X`` is one character
    (``.``, a class or the like) and ``end`` plain text: ``(?:.*/)?(.+)\\.csv$``.
    Any other rule runs as it is written, unanchored, at whatever cost it has on a
    path that does not match; with ``bounded`` it is refused, and paths of several
    lines have no name by a rule of your own.
    """
    path = as_column(path)
    usable = [rule for rule in rules if _usable(rule)]
    refused = [x for x in usable if bounded and x not in _DIRECT_RULES and not _ENDING_RULE.fullmatch(x)]
    if refused:
        raise ValueError(f"rules that may take more than linear time: {refused}")
    candidates = [_rule_name(path, rule, bounded) for rule in usable]
    if not candidates:
        return F.lit(None).cast("string")
    # Like strip_extension, in a form that names the long expression only once.
    return _underscored(
        F.regexp_replace(F.coalesce(*candidates), _EXTENSION, "$1")
    )


def redirect_path(
    path: Column | str, bucket: str, run_id: str, keep_unmatched: bool = True
) -> Column:
    """Destination ``s3://{bucket}/{run_id}/tmp/{base}.parquet`` of a path.

    ``base`` is the name up to the first dot. Paths without one stay as they are,
    or become null with ``keep_unmatched=False``.
    """
    path = as_column(path)
    prefix = F.lit(redirect_prefix(bucket, run_id))
    target = F.concat(prefix, base_name_first_dot(path), F.lit(REDIRECT_SUFFIX))
    return F.coalesce(target, path) if keep_unmatched else target


def unique_path(
    bucket: str, base: str, suffix: str = "/", scheme: str = UNIQUE_SCHEME
) -> Column:
    """A destination of its own for every row: ``{scheme}{bucket}/{base}/{uuid}{suffix}``.

    The value is drawn anew whenever the plan is evaluated: write the table
    before using the column twice.
    """
    return F.concat(F.lit(f"{scheme}{bucket}/{base}/"), F.uuid(), F.lit(suffix))


def redirect_prefix(bucket: str, run_id: str) -> str:
    """What every destination of a run starts with."""
    if not bucket or not run_id:
        raise ValueError("bucket and run id must not be empty")
    return f"{REDIRECT_SCHEME}{bucket}/{run_id}/{REDIRECT_FOLDER}/"


def redirect_location(path: str, root: str, run_id: str) -> str:
    """``redirect_path`` for one path on the driver, below any root."""
    if not root or not run_id:
        raise ValueError("root and run id must not be empty")
    named = re.search(_FIRST_DOT, path or "")
    if named is None:
        return path
    folder = f"{root.rstrip('/')}/{run_id}/{REDIRECT_FOLDER}"
    return f"{folder}/{named.group(1)}{REDIRECT_SUFFIX}"


def unique_location(root: str, suffix: str = "/") -> str:
    """A path below ``root`` that no other write uses."""
    if not root:
        raise ValueError("root must not be empty")
    return f"{root.rstrip('/')}/{uuid.uuid4()}{suffix}"


def _last_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(name: Column) -> Column:
    """A name that has a dot, up to its last one."""
    extension = F.substring_index(name, ".", -1)
    return F.left(name, F.char_length(name) - F.char_length(extension) - 1)


def _from_last_line(path: Column) -> Column:
    """A path from the line that holds its last slash on.

    Names after the last dot or slash lie there: what stands before cannot match, and
    would be tried from every line start. No slash is left after the first line, so
    the first candidate of these rules decides.
    """
    last = _last_part(path)
    before = F.left(path, F.char_length(path) - F.char_length(last))
    return F.concat(F.substring_index(before, "\n", -1), last)


def _or_regex(name: Column, path: Column, pattern: str, searched: Column | None = None) -> Column:
    """``name`` as cut from a one-line path, or else what ``pattern`` finds."""
    is_plain = (name != "") & ~path.contains("\n")
    found = first_match(path if searched is None else searched, pattern)
    return F.when(is_plain, name).otherwise(found)


def _underscored(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("_"))


def _special_name(path: Column) -> Column:
    found = first_match(path, rf"(F8\.TBLR)\.[^/]*{_END}")
    return F.when(path.contains("F8.TBLR."), found)


_NO_NAMES = ("", ".", "..")

# The ready rules have direct forms; any other rule runs as the regex it is.
_DIRECT_RULES: dict[str, Callable[[Column], Column]] = {
    RULE_FIRST_DOT: base_name_first_dot,
    RULE_LAST_DOT: base_name,
    RULE_SPECIAL_NAME: _special_name,
    RULE_PLAIN_NAME: _last_part,
}


# Group 1: one character, repeated and captured; group 2: plain text up to the end.
_ENDING_RULE = re.compile(
    r"""\(\?:\.\*/\)\?\((\.|\\[wWdDsS]|\[\^?[^\[\]\\^&]+\])\+\)((?:\\[^\w\s]|[^\\\[\](){}.*+?|^$#\s])*)\$"""
)


def _rule_name(path: Column, rule: str, bounded: bool) -> Column:
    direct = _DIRECT_RULES.get(rule)
    if direct is not None:
        name = direct(path)
        return F.when(~name.isin(*_NO_NAMES), name)
    # (?d): only \n ends a line; (?U): \w and \d are Unicode-wide, as in Python.
    matches = F.regexp_extract_all(path, F.lit(f"(?dU){rule}"), F.lit(1))
    ending = _ENDING_RULE.fullmatch(rule)
    if ending:
        found = F.array(_name_before(path, ending[1], re.sub(r"\\(.)", r"\1", ending[2])))
        lines = F.array().cast("array<string>") if bounded else matches
        matches = F.when(path.contains("\n"), lines).otherwise(F.array_compact(found))
    # An array expression, so that the regex is not run a second time by a test.
    no_names = F.array(*map(F.lit, _NO_NAMES))
    return F.get(F.array_except(F.slice(matches, 1, 1), no_names), F.lit(0))


def _name_before(path: Column, character: str, end: str) -> Column:
    """What ``(?:.*/)?(X+)end$`` captures in a path of one line; null if nothing.

    The captured text ends where ``end`` begins and is a part of the run of such characters
    there. The rule prefers to begin behind a slash, the last one first, and else begins with
    the run. The run is read from its end: searched from the front, it would be tried from
    every character of the path.
    """
    body = F.left(path, F.char_length(path) - len(end))
    run = F.regexp_extract(F.reverse(body), rf"(?dU)\A({character}*+)", 1)

    def name(run: Column) -> Column:
        # Reversed: a slash that is the last character has nothing behind it.
        first, rest = F.left(run, F.lit(1)), F.substr(run, F.lit(2))
        return F.when(run != "", F.reverse(F.concat(first, F.substring_index(rest, "/", 1))))

    # An array of one, so that the run is found once.
    found = F.get(F.transform(F.array(run), name), F.lit(0))
    return F.when(F.endswith(path, F.lit(end)), found)


def _usable(rule: str) -> bool:
    try:
        return re.compile(rule).groups > 0
    except re.error as problem:
        warnings.warn(f"rule {rule!r} is skipped: {problem}", stacklevel=3)
        return False
