"""Text functions over columns of scripts, pages or documents.

Like the path functions these are native and row-wise: no Python workers, no
shuffle, whole texts.

The patterns are tokens: each match takes the plain text up to the next token as
well, so consecutive matches cover a text without gaps, no position is tried
twice, and a text of any length costs linear time and no regex stack.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataroute.functions import scanner
from dataroute.functions._columns import as_column
from dataroute.functions.paths import (
    REDIRECT_SUFFIX,
    UNIQUE_SCHEME,
    base_name_first_dot,
    redirect_prefix,
)

# --- Fixed values: preview form and the names used by rewritten calls ---------
PREVIEW_LENGTH = 100
PREVIEW_MARK = "..."
TARGET_METHOD = "parquet"
BUCKET_VARIABLE = "S3_BUCKET"
BASE_PATH_VARIABLE = "S3_BASE_PATH"
# ------------------------------------------------------------------------------

_ANY = r"(?s:.)"
_END = f"(?!{_ANY})"

# Group 1 is a quoted literal: a quote, one character of any kind, then everything
# up to the same quote on the same line. There are no back-references, so each
# quote has its own branch. Quotes that open no literal are stepped over.
_QUOTED = (
    r"""[^"']*+(?:("[^\n][^"\n]*+"|'[^\n][^'\n]*+')|["']|""" + _END + ")"
)

# Python string literals. Possessive repeats keep long literals off the stack.
_ESCAPE = rf"\\(?:\r\n|{_ANY})"
_SHORT_STRING = (
    rf'"[^"\\\n]*+(?:{_ESCAPE}[^"\\\n]*+)*+"'
    rf"|'[^'\\\n]*+(?:{_ESCAPE}[^'\\\n]*+)*+'"
)
_LONG_STRING = r'"""(?s:.*?)"""' + r"|'''(?s:.*?)'''"
_STRING = f"{_LONG_STRING}|{_SHORT_STRING}"
_SPACE = r"(?:\s++|#[^\n]*+|\\\r?\n)*+"


# Lines before the first statement: blank ones and comments, a docstring, __future__
# imports. Strings and comments are replaced before the imports of a script are looked up.
_BLANK = r"[ \t\f]*(?:#[^\n]*)?\r?\n"
_LINE_END = r"[ \t]*;?[ \t]*(?:#[^\n]*)?\r?\n"
_FUTURE = r"from[ \t]+__future__[ \t]+import[ \t]*(?:\([^)]*\)|[^\n(#;]*)" + _LINE_END
_HEAD = (
    rf"\A(?:{_BLANK})*+(?:(?>[uUrR]?(?:{_STRING})(?:[ \t]*+[uUrR]?(?:{_STRING}))*+){_LINE_END})?+"
    rf"(?:{_BLANK}|{_FUTURE})*+"
)
_IMPORT_UUID = (
    r"(?m)^import[ \t]+(?:[\w.]+(?:[ \t]+as[ \t]+\w+)?[ \t]*,[ \t]*)*uuid[ \t]*(?:[,;#]|\r?$)"
)


def clip(text: Column | str, length: int = PREVIEW_LENGTH) -> Column:
    """The first ``length`` characters, marked with ``...`` where text was cut."""
    text = as_column(text)
    cut = F.concat(F.left(text, F.lit(length)), F.lit(PREVIEW_MARK))
    return F.when(F.char_length(text) > length, cut).otherwise(text)


def quoted(text: Column | str) -> Column:
    """All quoted literals of a text, quotes included, in order."""
    return _named(as_column(text), _QUOTED)


def unquoted(literal: Column | str) -> Column:
    """The content between the first and the last character of a literal."""
    literal = as_column(literal)
    return F.substr(literal, F.lit(2), F.char_length(literal) - 2)


def rewrite_literals(text: Column | str, bucket: str, run_id: str) -> Column:
    """Point every quoted literal that names a file at its run destination.

    A literal names a file when it has a name up to a first dot; its quotes stay,
    and so does every byte of text around the literals.
    """
    prefix = F.lit(redirect_prefix(bucket, run_id))
    text = as_column(text)
    pieces = F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(0))
    # A second pass for the literals costs less than finding them in their pieces, which
    # would be interpreted; measured on scripts and on pages.
    literals = F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(1))

    def redirected(piece: Column, literal: Column) -> Column:
        lead = F.left(piece, F.char_length(piece) - F.char_length(literal))
        quote = F.left(literal, F.lit(1))
        base = base_name_first_dot(unquoted(literal))
        # Null for a literal that names no file: concat of a null is null.
        target = F.concat(lead, quote, prefix, base, F.lit(REDIRECT_SUFFIX), quote)
        # Names have a dot: all other pieces stay without a further look.
        return F.when(literal.contains("."), F.coalesce(target, piece)).otherwise(piece)

    return F.array_join(F.zip_with(pieces, literals, redirected), "")


def called_literals(text: Column | str, method: str = TARGET_METHOD) -> Column:
    """The literals, as written, that ``.method("literal"`` calls in a script name.

    A call counts when its first argument is a plain string literal, in adjacent
    parts or one, in brackets or not: keyword arguments, variables, f-strings, byte
    strings and expressions on a literal do not, nor does anything inside a comment or
    another string. Calls in the replacement fields of f-strings do count.

    Tokens of a regex find these in most scripts. Whether a quote inside an f-string
    ends it, and where brackets around a literal end, no regex can tell: scripts with
    one of these go to the scanner, which costs some ten times as much.
    """
    text = as_column(text)

    def scanned(script: Column) -> Column:
        places, found = scanner.call_places(script, [method]), scanner.pieces(script)
        # Pieces in an array of one, so that they are found once for all literals.
        literals = F.transform(
            F.array(F.struct(places.alias("places"), found.alias("found"))),
            lambda x: F.transform(x["places"], lambda place: scanner.literal_of(x["found"], place)),
        )
        return F.get(literals, F.lit(0))

    return F.when(_needs_scanner(text, method), _of_one(text, scanned)).otherwise(_named(text, _calls(method)))


def literal_content(literal: Column | str) -> Column:
    """What a literal as written says, escapes as they stand; adjacent parts join."""
    return scanner.content(as_column(literal))


def rewrite_calls(
    text: Column | str,
    method: str = TARGET_METHOD,
    bucket_variable: str = BUCKET_VARIABLE,
    base_path_variable: str = BASE_PATH_VARIABLE,
    scheme: str = UNIQUE_SCHEME,
    suffix: str = "/",
    definitions: tuple[str, str] | None = None,
) -> Column:
    """Let every ``.method("literal"`` call use a new location each time it runs.

    The literal becomes an f-string over the script's own bucket and base path
    variables and a fresh UUID. All other text, comments included, is unchanged.

    With ``definitions``, a bucket and a base path, a script with such a call also
    gets what it lacks of ``import uuid`` and the two assignments, in front of its
    first statement but behind its docstring and ``__future__`` imports.
    """
    text = as_column(text)
    target = (
        f'f"{scheme}{{{bucket_variable}}}/{{{base_path_variable}}}'
        f'/{{uuid.uuid4()}}{suffix}"'
    )
    call, literal = _call(method)
    pieces = F.regexp_extract_all(text, F.lit(_tokens(call, literal)), F.lit(0))

    def replaced(piece: Column) -> Column:
        # Few pieces name the method; only these are looked at again.
        is_call = piece.contains(method) & (F.endswith(piece, F.lit('"')) | F.endswith(piece, F.lit("'")))
        other = F.regexp_replace(piece, rf"\A([^.#\"']*+{call}){literal}{_END}", f"$1{_plain(target)}")
        return F.when(is_call, other).otherwise(piece)

    changed = F.when(
        _needs_scanner(text, method), _of_one(text, lambda script: scanner.replaced(script, [method], F.lit(target)))
    ).otherwise(F.array_join(F.transform(pieces, replaced), ""))
    if definitions is None:
        return changed
    bare = F.regexp_replace(text, rf"#[^\n]*+|{_STRING}", "0")
    lines = [F.when(~bare.rlike(_IMPORT_UUID), F.lit("import uuid\n"))]
    for name, value in zip((bucket_variable, base_path_variable), definitions, strict=True):
        assigned = rf"(?m)^(?:\w+[ \t]*=[ \t]*)*{re.escape(name)}[ \t]*(?::[^=\n]*)?=(?!=)"
        lines.append(F.when(~bare.rlike(assigned), F.lit(f"{name} = {value!r}\n")))
    missing = F.concat(*[F.coalesce(line, F.lit("")) for line in lines])

    def defined(script: Column) -> Column:
        head = F.regexp_extract(text, _HEAD, 0)
        return F.when(script != text, F.concat(head, missing, _after(script, head))).otherwise(script)

    # An array of one, so that the rewritten script is computed once.
    return F.get(F.transform(F.array(changed), defined), F.lit(0))


def _after(text: Column, head: Column) -> Column:
    return F.substr(text, F.char_length(head) + 1)


def _plain(replacement: str) -> str:
    """A replacement in which ``$`` and backslashes are what they look like."""
    return re.sub(r"([\\$])", r"\\\1", replacement)


def _call(method: str) -> tuple[str, str]:
    """Patterns of a call up to its literal, and of the literal that a bracket or comma follows."""
    # Atomic: a literal that no comma or bracket follows must not run on to the next.
    part = rf"[uUrR]?(?:{_STRING})"
    literal = rf"(?>{part}(?:{_SPACE}{part})*+)"
    return rf"\.{_SPACE}{re.escape(method)}{_SPACE}\({_SPACE}", literal


def _of_one(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _needs_scanner(text: Column, method: str) -> Column:
    """Whether a script has f-strings or the like, brackets around a first argument, or
    line ends of one carriage return."""
    call, _ = _call(method)
    # Each pattern begins with the sign that is seldom there, which is what a search is fast at.
    prefixed = r"""["'](?<=(?<![A-Za-z0-9_])(?i:[ft]r?|r[ft])["'])"""
    return text.rlike(prefixed) | text.rlike(call + r"\(") | (text.contains("\r") & text.rlike(r"\r(?!\n)"))


def _calls(method: str) -> str:
    """Group 1 is the literal of a call; comments and other strings are tokens too."""
    return _tokens(*_call(method))


def _tokens(call: str, literal: str) -> str:
    return rf"[^.#\"']*+(?:{call}({literal})(?={_SPACE}[,)])|#[^\n]*+|{_STRING}|[.#\"']|{_END})"


def _named(text: Column, tokens: str) -> Column:
    """Group 1 of every token that has one."""
    return F.array_remove(F.regexp_extract_all(text, F.lit(tokens), F.lit(1)), "")
