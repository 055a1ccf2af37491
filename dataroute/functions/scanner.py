"""Calls in a script as a scanner of the language sees them.

A script is cut into pieces, each some plain text and the one sign behind it that can
change what follows: a quote, a bracket, a comment's start, a line's end. A fold over the
pieces carries what a scanner has to remember: which strings, f-strings, replacement fields
and format specifications are open inside each other, and how far a call that is looked for
has come. It is one native expression; a script costs time in proportion to its pieces. Spark
interprets it, so what a piece does is looked up in tables that the rules below fill.

Frames on the stack, innermost last: ``s t S T`` strings by their quotes, ``a b A B``
f-strings, ``x`` a replacement field, ``y`` its format specification, ``( [ {`` brackets
in a field, ``c`` a comment. An empty stack is plain code. A second stack has a letter for
each open bracket and one for the present: the way of the chain of attributes and calls there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

READ, WRITE = "read", "write"
#: Attributes that say which way the calls behind them go, and a letter for each way.
ROLES = {READ: ("read", "readStream"), WRITE: ("write", "writeStream")}
_LETTERS = {READ: "r", WRITE: "w"}

_QUOTES = ('"', "'", '"""', "'''")
_PLAIN_PREFIXES = ("", "r", "u")
_F_PREFIXES = ("f", "fr", "rf", "t", "tr", "rt")
_BYTES_PREFIXES = ("b", "br", "rb")
_BLANK = " \t\f"
#: The parser accepts far fewer open brackets; deeper ones are no script.
_DEEPEST = 1000

# A backslash takes the next character along, a line's end or a character's name whole;
# braces behind one still open and close fields.
_PIECE = (
    r"""([^"'#(){}\[\],.:\\\r\n]*+)"""
    r"""(\{\{|\}\}|\"\"\"|'''|["'#(){}\[\],.:]|\r\n?|\n"""
    r"""|\\(?:\r\n|N\{[^{}"'\r\n]*\}|(?s:[^{}])|)|(?!(?s:.)))"""
)

# One part of a literal: its content is the one group that is set.
_ESCAPE = r"\\(?:\r\n|(?s:.))"
_PART = (
    r"(?:\s++|#[^\n]*+|\\\r?\n)*+"
    r'[uUrR]?(?:"""((?s:.*?))"""'
    r"|'''((?s:.*?))'''"
    rf'|"([^"\\\n]*+(?:{_ESCAPE}[^"\\\n]*+)*+)"'
    rf"|'([^'\\\n]*+(?:{_ESCAPE}[^'\\\n]*+)*+)')"
)

# How far a call has come: behind a dot, the method, its bracket (and brackets in it), the
# literal, and a bracket that closes around the literal.
_NOTHING, _DOT, _NAMED, _OPEN, _LITERAL, _CLOSED = range(6)

_FOUND = "array<struct<first:int,last:int,role:string>>"

# Numbers of the signs as the tables have them. A quote counts by the prefix in front of it.
_SIGNS = ("", '"', "'", "#", "(", ")", "[", "]", ",", ".", ":", "{", "}", '"""', "'''", "{{", "}}")
_END, _JOINED_END, _ESCAPED, _BYTES, _FORMAT = (len(_SIGNS) + k for k in (0, 1, 2, 3, 3 + len(_QUOTES)))
_N_SIGNS = _FORMAT + len(_QUOTES)
_SINGLE = "_" + "".join(x for x in _SIGNS if len(x) == 1)

# Numbers of the frames: by their place here, and 0 without any.
_FRAMES = "_x([{ycstSTabAB"
_CODE = _FRAMES.index("y")

# What a sign does to the innermost frame.
_NONE, _IN_CODE, _CLOSES, _BREAKS, _ENDS, _FIELD, _FIELD_AND_BRACE, _BRACE, _BRACES = range(9)

# What the piece's plain text is.
_BLANK_RUN, _METHOD_RUN, _OTHER_RUN = range(3)


def pieces(text: Column) -> Column:
    """The pieces of a script: together they are the script."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def call_places(text: Column, methods: Sequence[str]) -> Column:
    """``(first, last, role)`` of every call of one of ``methods`` whose first argument is a
    plain string literal: the pieces, from 1 on, in which the literal begins and ends.

    The literal can be in brackets, in adjacent parts, behind comments and line ends. Calls
    in comments and strings do not count, those in the replacement fields of f-strings do.
    ``role`` is ``read`` or ``write`` by the last such attribute in the call's own chain of
    attributes and calls, or null.
    """
    runs = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))
    signs = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(2))
    read = F.transform(F.arrays_zip(runs.alias("run"), signs.alias("sign")), lambda x, k: _token(x, k, methods))
    return F.get(F.transform(F.array(read), _folded), F.lit(0))


def _token(piece: Column, k: Column, methods: Sequence[str]) -> Column:
    """What a piece says wherever it stands."""
    run, sign = piece["run"], piece["sign"]
    letters = F.lower(F.regexp_extract(run, "[A-Za-z]*$", 0))
    known = F.when(letters.isin(*_PLAIN_PREFIXES, *_F_PREFIXES, *_BYTES_PREFIXES), letters).otherwise("")
    is_quote = F.startswith(sign, F.lit('"')) | F.startswith(sign, F.lit("'"))
    prefix = F.when((run != "") & is_quote, known).otherwise("")

    def told(x: Column) -> Column:
        name = F.left(run, F.char_length(run) - F.char_length(x["prefix"]))
        word = F.when(run == "", run).otherwise(F.btrim(F.when(x["prefix"] == "", run).otherwise(name), F.lit(_BLANK)))
        return F.struct(word.alias("word"), _number(sign, x["prefix"]).alias("sign"))

    def token(x: Column) -> Column:
        word = x["word"]
        role = F.lit(None).cast("string")
        for name, attributes in ROLES.items():
            role = F.when(word.isin(*attributes), _LETTERS[name]).otherwise(role)
        return F.struct(
            (k + 1).alias("at"),
            x["sign"].alias("sign"),
            F.when(word == "", _BLANK_RUN).when(word.isin(*methods), _METHOD_RUN).otherwise(_OTHER_RUN).alias("run"),
            F.when(word != "", role).alias("role"),
            _of(_FRAME_PUSHED, x["sign"]).alias("frame"),
        )

    return _let(token, _let(told, F.struct(prefix.alias("prefix"))))


def _let(function: Callable[[Column], Column], value: Column) -> Column:
    """``function`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _of(table: Sequence, k: Column) -> Column:
    return F.get(F.lit(list(table)), k)


def _number(sign: Column, prefix: Column) -> Column:
    single = F.instr(F.lit(_SINGLE), sign) - 1
    plain = F.when(sign == '"""', _SIGNS.index('"""')).when(sign == "'''", _SIGNS.index("'''"))
    plain = plain.when(sign == "{{", _SIGNS.index("{{")).when(sign == "}}", _SIGNS.index("}}"))
    plain = plain.when(sign.rlike(r"\A[\r\n]"), _END).when(sign.rlike(r"\A\\[\r\n]"), _JOINED_END).otherwise(_ESCAPED)
    number = F.when(single >= 0, single).otherwise(plain)
    quote = F.when(sign == '"', 0).when(sign == "'", 1).when(sign == '"""', 2).otherwise(3)
    other = F.when(prefix.isin(*_F_PREFIXES), _FORMAT).otherwise(_BYTES)
    return F.when(prefix.isin(*_PLAIN_PREFIXES), number).otherwise(other + quote)


def _sign(k: int) -> str:
    """The sign of a number; quotes without their prefix."""
    if k >= _BYTES:
        return _QUOTES[(k - _BYTES) % len(_QUOTES)]
    return _SIGNS[k] if k < len(_SIGNS) else ("\n" if k < _ESCAPED else "\\")


def _pushed(k: int) -> str:
    """The frame that a sign in code puts on the stack."""
    sign = _sign(k)
    if sign in _QUOTES:
        return ("abAB" if k >= _FORMAT else "stST")[_QUOTES.index(sign)]
    return {"#": "c", "(": "(", "[": "[", "{": "{", "{{": "{{"}.get(sign, "")


def _done(frame: str, k: int) -> int:
    """What a sign does to a frame."""
    sign = _sign(k)
    if frame in "_x([{":
        return _IN_CODE
    if frame == "c":
        return _ENDS if sign == "\n" else _NONE
    # ``"a"""`` closes a string and has an empty one behind it.
    closing = {"s": '""""', "a": '""""', "t": "''''", "b": "''''"}
    if frame in "satb" and sign in (closing[frame][:1], closing[frame][:3]):
        return _CLOSES
    if frame in "SA" and sign == '"""' or frame in "TB" and sign == "'''":
        return _CLOSES
    # A short string that its line does not close is an error; the line closes it here.
    if frame in "stab" and k == _END:
        return _BREAKS
    if frame in "abABy" and sign == "{":
        return _FIELD
    if frame == "y":
        return {"{{": _FIELD_AND_BRACE, "}": _BRACE, "}}": _BRACES}.get(sign, _NONE)
    return _NONE


def _arrived(seen: int, deep: bool, run: int, k: int) -> int:
    """How far a call has come behind a piece in code."""
    seen = _said(seen, run)
    sign = _sign(k)
    if sign == ".":
        return _DOT
    if sign == "(":
        return _OPEN if seen in (_NAMED, _OPEN) else _NOTHING
    if sign == ")":
        return _CLOSED if seen in (_LITERAL, _CLOSED) and deep else _NOTHING
    if sign in _QUOTES:
        return seen if k < _BYTES and seen in (_OPEN, _LITERAL) else _NOTHING
    return seen if sign in ("#", "\n", "") else _NOTHING


def _said(seen: int, run: int) -> int:
    """The same behind its plain text alone."""
    if run == _BLANK_RUN:
        return seen
    return _NAMED if seen == _DOT and run == _METHOD_RUN else _NOTHING


_SIGN_NUMBERS = range(_N_SIGNS)
_FRAME_PUSHED = [_pushed(k) for k in _SIGN_NUMBERS]
_TOP_PUSHED = [_FRAMES.find(x[-1:] or "_") for x in _FRAME_PUSHED]
_DEEDS = [_done(x, k) for x in _FRAMES for k in _SIGN_NUMBERS]
_RUNS = (_BLANK_RUN, _METHOD_RUN, _OTHER_RUN)
_ARRIVALS = [
    _arrived(seen, deep, run, k)
    for seen in range(_CLOSED + 1) for deep in (False, True) for run in _RUNS for k in _SIGN_NUMBERS
]
_TURNS, _OPENS, _CLOSERS, _PARTS, _OTHERS = range(5)
_GROUPS = [
    _TURNS if x in (*_QUOTES, "#") else _OPENS if x in ("(", "[", "{", "{{") else _CLOSERS if x in (")", "]", "}", "}}")
    else _PARTS if x == ":" else _OTHERS
    for x in map(_sign, _SIGN_NUMBERS)
]

_NAMES = ("stack", "top", "seen", "depth", "first", "last", "ways", "now", "way", "found")


def _folded(tokens: Column) -> Column:
    # ``top`` is the innermost frame's number; ``now`` is the present way, ``ways`` has those around it.
    values = dict.fromkeys(_NAMES, F.lit(0)) | {
        "stack": F.lit(""), "ways": F.lit(""), "now": F.lit("-"), "way": F.lit("-"), "found": F.array().cast(_FOUND)
    }
    start = F.struct(*(x.alias(name) for name, x in values.items()))

    def chunk(state: Column, own: Column) -> Column:
        done = F.aggregate(own, _state(state["now"], found=F.array().cast(_FOUND)), _step)

        def joined(x: Column) -> Column:
            return F.struct(x.alias("now"), F.concat(state["found"], F.array(x["found"])).alias("found"))

        return _let(joined, done)

    # In chunks: appending copies what a fold has found, here one chunk's calls.
    size = F.ceil(F.sqrt(F.size(tokens))).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.size(tokens), size), lambda k: F.slice(tokens, k, size))
    outer = F.struct(start.alias("now"), F.array().cast(f"array<{_FOUND}>").alias("found"))
    return F.aggregate(chunks, outer, chunk, lambda s: F.flatten(s["found"]))


def _state(state: Column, **changed: Column) -> Column:
    return F.struct(*(changed.get(x, state[x]).alias(x) for x in _NAMES))


def _cut(stack: Column, n: Column | int) -> dict[str, Column]:
    """The stack without its innermost ``n`` frames."""
    rest = F.left(stack, F.octet_length(stack) - n)
    return {"stack": rest, "top": F.instr(F.lit(_FRAMES), F.right(rest, F.lit(1))) - 1}


def _grown(stack: Column, frames: Column, top: Column) -> dict[str, Column]:
    """The stack with ``frames``, or an empty one that has become too deep."""
    deep = F.octet_length(stack) + F.octet_length(frames) > _DEEPEST
    return {"stack": F.when(deep, "").otherwise(F.concat(stack, frames)), "top": F.when(deep, 0).otherwise(top)}


def _step(state: Column, token: Column) -> Column:
    stack, seen = state["stack"], state["seen"]
    deed = _of(_DEEDS, state["top"] * _N_SIGNS + token["sign"])
    field, brace = (F.lit(_FRAMES.index(x)) for x in "x{")
    return (
        F.when(state["top"] < _CODE, _code(state, token))
        .when(deed == _NONE, state)
        .when(
            deed == _CLOSES,
            _state(
                state,
                **_cut(stack, 1),
                seen=F.when(seen >= _OPEN, F.lit(_LITERAL)).otherwise(F.lit(_NOTHING)),
                last=token["at"],
            ),
        )
        .when(deed == _FIELD, _state(state, stack=F.concat(stack, F.lit("x")), top=field))
        .when(deed == _BREAKS, _state(state, **_cut(stack, 1), seen=F.lit(_NOTHING)))
        .when(deed == _FIELD_AND_BRACE, _state(state, stack=F.concat(stack, F.lit("x{")), top=brace))
        .when(deed == _BRACES, _state(state, **_cut(stack, _braces(stack))))
        .otherwise(_state(state, **_cut(stack, 1)))
    )


def _braces(stack: Column) -> Column:
    """How many of the two innermost frames two braces close."""
    return F.when(stack.rlike(r"[{xy][{xy]\z"), 2).when(stack.rlike(r"[{xy]\z"), 1).otherwise(0)


def _code(state: Column, token: Column) -> Column:
    stack, top, seen, depth, ways = (state[x] for x in ("stack", "top", "seen", "depth", "ways"))
    sign, blank = token["sign"], token["run"] == _BLANK_RUN
    place = F.when(depth > 0, seen * 2 + 1).otherwise(seen * 2) * len(_RUNS) + token["run"]
    arrived = _of(_ARRIVALS, place * _N_SIGNS + sign)
    # An attribute can turn its chain; a name that no dot leads begins a new one.
    now = (
        F.when(blank, state["now"])
        .when(seen != _DOT, F.lit("-"))
        .otherwise(F.coalesce(token["role"], state["now"]))
    )
    comma, opened, closed = (_SIGNS.index(x) for x in (",", "(", ")"))
    is_call = (seen >= _LITERAL) & blank & (depth == 0) & ((sign == comma) | (sign == closed))
    role = F.when(state["way"] == _LETTERS[READ], READ).when(state["way"] == _LETTERS[WRITE], WRITE)
    call = F.struct(state["first"].alias("first"), state["last"].alias("last"), role.alias("role"))
    found = F.when(is_call, F.concat(state["found"], F.array(call))).otherwise(state["found"])
    named = F.when(blank, seen == _NAMED).otherwise((seen == _DOT) & (token["run"] == _METHOD_RUN))
    pushed = _of(_TOP_PUSHED, sign)
    group = _of(_GROUPS, sign)
    common = {"seen": arrived, "now": now}

    # Brackets count inside replacement fields only.
    inside = F.when(top == 0, F.lit("")).otherwise(token["frame"])
    outer = F.concat(ways, now, F.when(sign == _SIGNS.index("{{"), F.lit("-")).otherwise(F.lit("")))
    too_deep = F.octet_length(outer) >= _DEEPEST
    in_bracket = _state(
        state,
        **_grown(stack, inside, F.when(top == 0, 0).otherwise(pushed)),
        seen=arrived,
        depth=F.when(sign != opened, depth).when(named, 0).otherwise(depth + 1),
        way=F.when((sign == opened) & named, now).otherwise(state["way"]),
        ways=F.when(too_deep, F.lit("")).otherwise(outer),
        now=F.lit("-"),
    )
    n = F.when(sign == _SIGNS.index("}}"), 2).otherwise(1)
    known = F.octet_length(ways) >= n
    frames = (
        F.when(top == 0, 0)
        .when(sign == _SIGNS.index("}}"), _braces(stack))
        .when(sign == _SIGNS.index("}"), F.when(top.isin(_FRAMES.index("x"), _FRAMES.index("{")), 1).otherwise(0))
        .when((sign == closed) & (top == _FRAMES.index("(")), 1)
        .when((sign == _SIGNS.index("]")) & (top == _FRAMES.index("[")), 1)
        .otherwise(0)
    )
    out_of_bracket = _state(
        state,
        **_bounded(_cut(stack, frames)),
        seen=arrived,
        depth=F.when(sign == closed, depth - 1).otherwise(depth),
        ways=F.when(known, F.left(ways, F.octet_length(ways) - n)).otherwise(ways),
        now=F.when(known, F.substr(ways, F.octet_length(ways) - n + 1, F.lit(1))).otherwise(now),
        found=found,
    )
    first = F.when(blank & (seen == _OPEN), token["at"]).otherwise(state["first"])
    # The quote in front of a literal, not a comment's start.
    first = F.when(sign == _SIGNS.index("#"), state["first"]).otherwise(first)
    turned = _state(state, **_grown(stack, token["frame"], pushed), **common, first=first)
    shaped = F.concat(F.left(stack, F.octet_length(stack) - 1), F.lit("y"))
    part = _state(state, **_bounded({"stack": shaped, "top": F.lit(_FRAMES.index("y"))}), **common)
    other = _state(state, **_bounded({"stack": stack, "top": top}), **common, found=found)
    return (
        F.when((group == _OTHERS) | ((group == _PARTS) & (top != _FRAMES.index("x"))), other)
        .when(group == _TURNS, turned)
        .when(group == _OPENS, in_bracket)
        .when(group == _CLOSERS, out_of_bracket)
        .otherwise(part)
    )


def _bounded(frames: dict[str, Column]) -> dict[str, Column]:
    """The stack, or an empty one that has become too deep."""
    deep = F.octet_length(frames["stack"]) > _DEEPEST
    return {"stack": F.when(deep, "").otherwise(frames["stack"]), "top": F.when(deep, 0).otherwise(frames["top"])}


def literal_of(found: Column, place: Column) -> Column:
    """The literal at a place, as written, from the pieces ``found``."""
    return F.btrim(
        F.array_join(F.slice(found, place["first"], place["last"] - place["first"] + 1), ""), F.lit(_BLANK)
    )


def content(literal: Column) -> Column:
    """What a literal as written says, escapes as they stand; adjacent parts join."""
    return F.regexp_replace(literal, _PART, "$1$2$3$4")


def replaced(text: Column, methods: Sequence[str], target: Column) -> Column:
    """``text`` with ``target`` for the literal of every call that counts."""

    def joined(parts: Column) -> Column:
        places, found = parts["places"], parts["found"]

        def one(place: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(places, k - 1)["last"]).otherwise(F.lit(0))
            between = F.slice(found, before + 1, place["first"] - before - 1)
            opening = F.get(found, place["first"] - 1)
            lead = F.left(opening, F.char_length(opening) - F.char_length(F.ltrim(opening, F.lit(_BLANK))))
            return F.concat(F.array_join(between, ""), lead, target)

        end = F.coalesce(F.get(places, F.size(places) - 1)["last"], F.lit(0))
        rest = F.slice(found, end + 1, F.size(found))
        return F.concat(F.array_join(F.transform(places, one), ""), F.array_join(rest, ""))

    both = F.struct(call_places(text, methods).alias("places"), pieces(text).alias("found"))
    return F.get(F.transform(F.array(both), joined), F.lit(0))
