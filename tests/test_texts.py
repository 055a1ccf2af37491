"""Text functions: golden scripts, brute force, and Python's own parser as judge."""

import ast
import contextlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import dataroute as dr

# --- Fixed values: the defining regexes -----------------------------------------
QUOTED = r"""(["'])(.+?)\1"""
FIRST_DOT = r"(?:.*/)?([^.]+)\.[^/]*$"
# ----------------------------------------------------------------------------------

NIGHTLY = '''
import sys
from pyspark.sql import functions as F

def main(spark, day):
    # stations report twice; 'late' rows win
    stations = spark.table("weather.stations")
    readings = spark.read.orc("hdfs:///feeds/readings.2021.orc")
    skipped = spark.read.text('/etc/skip_list')
    readings.unionByName(stations, allowMissingColumns=True)
    limits = {"cold": -40, 'hot': 55, "file": '{home}/limits/all.v2.yaml'}
    hourly = readings.groupBy("station", F.window("at", '1 hour')).count()
    report = '../reports/hourly.html'
    hourly.toPandas().to_html(report)
    print("see 'notes/today.txt' or ask")
    sys.exit('done.')
'''

NIGHTLY_LITERALS = [
    ("late", None),
    ("weather.stations", "weather"),
    ("hdfs:///feeds/readings.2021.orc", "readings"),
    ("/etc/skip_list", None),
    ("cold", None),
    ("hot", None),
    ("file", None),
    ("{home}/limits/all.v2.yaml", "all"),
    ("station", None),
    ("at", None),
    ("1 hour", None),
    ("../reports/hourly.html", "hourly"),
    ("see 'notes/today.txt' or ask", "today"),
    ("done.", "done"),
]

EXPORTS = '''
def export(kind, frame):
    """Writes a frame.

    Older versions called frame.write.parquet("docs/old.parquet") here.
    """
    help_text = 'usage: x.parquet("help/usage.parquet")'
    target = "exports/latest.parquet"
    if kind == "fixed":
        frame.repartition(4).write.parquet("exports/fixed.parquet", 'errorifexists')
    elif kind == 'variable':
        frame.write.parquet(target)
    elif kind == "keyword":
        frame.write.parquet(path="exports/keyword.parquet", mode='append')
    else:
        frame.write.option("header", True).csv('exports/other.csv')  # .parquet('exports/x')
    return spark.read.schema(frame.schema).parquet('exports/fixed.parquet')
'''

CALL_SCRIPTS = [
    EXPORTS,
    'a.parquet("x")',
    "a.parquet ( \n 'x/y.z' , mode='m')",
    "a.b.parquet('''long\nname.csv''')",
    "a.parquet(r'raw\\x', 1); a.parquet(u'prefixed.csv')",
    "a.parquet(f'{x}/y.parquet')",
    'a.parquet("""x""" + """y""")',
    "a.parquet('x' + 'y', 'z')",
    "a.parquet('x/'  # first\n  r\"y.csv\", 1)",
    "a.parquet('x' f'{y}')",
    "a.parquet('')",
    "a.parquet(\n    # where from\n    'x'\n)",
    "a.parquet(b'bytes.parquet')",
    "a.parquet('a' + b)",
    "a.parquet('%s.parquet' % b)",
    "a.parquet('{}.parquet'.format(b))",
    "a.parquet('it\\'s.parquet')",
    'a.parquet("")',
    "a.parquets('x'); a.csv('y'); parquet('z')",
    "a.parquet(b.parquet('inner.x'))",
    "a.parquet('first').parquet('second')",
    "# it's here: a.parquet('no')\na.parquet('yes')",
    "x = 'don\\'t'; a.parquet('é/😀.csv')",
]


# Brackets, line ends and f-strings, whose fields hold quotes, braces and calls of their own.
SCANNED_SCRIPTS = [
    'a.parquet(("a"))',
    'a.parquet(\\\n"b")',
    'x = f"{\'"\'}"; a.parquet("c")',
    'a.parquet((("a")), 1)',
    'a.parquet(("a", "b"))',
    'a.parquet(("a") + x)',
    'a.parquet(("a" "b"))',
    'f"{a.parquet("x")}"',
    'f\'{a.parquet("x"):>{w}}\'; a.parquet(\'y\')',
    'f"{{a.parquet(1)}}"; a.parquet("z")',
    'f"""{\n a.parquet("q") # it\'s\n}"""; a.parquet("w")',
    'rf"\\{a.parquet("k")}"',
    'f"\\{a.parquet("k")}"',
    'f"\\N{LATIN SMALL LETTER A}{a.parquet("n")}"',
    'f"{x!r:{"a"}}" "b"; a.parquet("v")',
    'x[":"]; d = {"a": f"{d["k"]}"}; a.parquet("u")',
    'f"{(lambda x: 1)(2)}"; a.parquet("t")',
    'f"{ {1: {2: 3}}[1] }"; a.parquet("s")',
    '\'\'\'a\'b"""\'\'\'; a.parquet(\'r\')',
    '"a""b"; a.parquet("o")',
    'a.parquet("a""")',
    'a.parquet("a" f"b")',
    'a.parquet(f"b" "a")',
    "a.parquet(b'x')",
    "a.parquet(Rb'x', 'y')",
    'a.parquet(*["x"])',
    'a.parquet("x" if y else "z")',
    'a.parquet(x="y")',
    'a.parquet()',
    '(a.\n parquet("x"))',
    '(a.parquet # c"\n("x"))',
    '# c \\\na.parquet("x")',
    "x = 'a\\\nb'; a.parquet('p')",
    'x = "a\\\r\nb"; a.parquet("p")',
    'a.parquet("a")("b")',
    'a.parquet("x"[0])',
    'a.parquet("x", b.parquet("y"))',
    'a.parquet(("x"), *z)',
    'f"{x:%H:%M}"; a.parquet("h")',
    "f'{x:{y}}}}'; a.parquet('i')",
    'f"{x=}"; a.parquet("j")',
    'f"{a["b"]:{c["d"]}.{e}}"; a.parquet("l")',
    'f\'{f"{f\'\'\'{1}\'\'\'}"}\'; a.parquet(\'m\')',
    'a.parquet("a"  # one\n  "b")',
    'a.parquet("x" % y)',
    'a.parquet("x" or "y")',
    'a.b.parquet.c("x")',
    'a.parquet\\\n("x")',
    'a.parquet(\n\n"x"\n\n)',
    'f"{x}}}{{"; a.parquet("g")',
    "f'{x:\\n}'; a.parquet('e')",
    'x: str = "a"; a.parquet("d")',
    'a[1:2].parquet("a1")',
    '{1:a.parquet("a2")}',
    'f"{a[1:2]}{a.parquet("a3")}"',
    "f'{x:{{1}.pop()}}'; a.parquet('a4')",
    't = "é😀"; a.parquet("é😀")',
    "a.parquet('')",
    'a.parquet(\'\' \'\' """x\n""")',
    "rt = f'{1}' rf'{2}' '{'; a.parquet('a5')",
    'a.parquet(("x" "y"), ("z"))',
    "a.parquet(('x')('y'))",
    "a.parquet(('x').y)",
    "a.parquet((('x') ))",
    "a.parquet(((('x')) # c)\n))",
    'f\'\'\'{\'a\'}\'{"b"}\'\'\'; a.parquet(\'a6\')',
]


def texts(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "id bigint, text string")


def named(content):
    found = re.search(FIRST_DOT, content)
    return found.group(1) if found else None


def rewritten(text):
    def target(match):
        base = named(match.group(2))
        return f"{match.group(1)}s3://b/r1/tmp/{base}.parquet{match.group(1)}" if base else match.group(0)

    return re.sub(QUOTED, target, text)


def parsed_calls(script, method="parquet"):
    """First string argument of every ``.method(...)`` call, in source order."""
    calls = [
        node.args[0]
        for node in ast.walk(ast.parse(script))
        if isinstance(node, ast.Call)
        and isinstance(node.func, ast.Attribute)
        and node.func.attr == method
        and node.args
        and isinstance(node.args[0], ast.Constant)
        and isinstance(node.args[0].value, str)
    ]
    calls.sort(key=lambda node: (node.lineno, node.col_offset))
    return [ast.get_source_segment(script, node) for node in calls]


def test_golden_literals(spark):
    rows = dr.quoted_literals(texts(spark, [NIGHTLY]), "text").orderBy("pos").collect()
    assert [(row.literal, named(row.literal)) for row in rows] == NIGHTLY_LITERALS
    assert [row.pos for row in rows] == list(range(len(NIGHTLY_LITERALS)))
    assert {row.quote for row in rows} == {'"', "'"}


def test_golden_rewrite(spark):
    short = "cities = load('ftp://mirror/geo/cities15000.zip')"
    df = texts(spark, [NIGHTLY, short]).orderBy("id")
    rows = df.select(dr.rewrite_literals("text", "bucket", "run-1")).collect()
    expected = NIGHTLY
    for literal, base in NIGHTLY_LITERALS:
        for quote in "'\"":
            if base:
                target = f"{quote}s3://bucket/run-1/tmp/{base}.parquet{quote}"
                expected = expected.replace(f"{quote}{literal}{quote}", target)
    assert rows[0][0] == expected
    assert rows[1][0] == "cities = load('s3://bucket/run-1/tmp/cities15000.parquet')"


def test_tokens_equal_the_definitions(spark):
    """All texts over the characters that matter."""
    items = ["".join(t) for n in range(8) for t in itertools.product("\"'a.\n", repeat=n)]
    df = texts(spark, items).select(
        "text",
        dr.quoted("text").alias("found"),
        dr.rewrite_literals("text", "b", "r1").alias("rewritten"),
    )
    for text, found, changed in df.collect():
        assert found == [m.group(0) for m in re.finditer(QUOTED, text)], repr(text)
        assert changed == rewritten(text), repr(text)


def test_null_and_empty_texts_stay(spark):
    df = texts(spark, [None, "", "no literals\nat all"])
    columns = [dr.rewrite_literals("text", "b", "r"), dr.rewrite_calls("text")]
    for text, *changed in df.select("text", *columns).collect():
        assert changed == [text, text]
    assert dr.quoted_literals(df, "text").count() == 0


def test_gaps_are_unchanged(spark):
    df = texts(spark, [NIGHTLY]).select("text", dr.rewrite_literals("text", "b", "r").alias("new"))
    text, changed = df.first()
    assert re.split(QUOTED, text)[::3] == re.split(QUOTED, changed)[::3]


@pytest.mark.parametrize("script", CALL_SCRIPTS)
def test_calls_equal_the_parser(spark, script):
    found = texts(spark, [script]).select(dr.called_literals("text")).first()[0]
    assert found == parsed_calls(script)


def _scripts():
    """Every form alone and in random company, as far as it is still a script."""
    chosen = random.Random(1)
    forms = [*SCANNED_SCRIPTS, *CALL_SCRIPTS]
    mixed = ["\n".join(chosen.choices(forms, k=chosen.randrange(2, 9))) for _ in range(600)]
    for script in [*forms, *mixed]:
        with contextlib.suppress(SyntaxError):
            ast.parse(script)
            yield script


@pytest.mark.filterwarnings("ignore::SyntaxWarning")
def test_scanned_calls_equal_the_parser(spark):
    scripts = list(_scripts())
    assert len(scripts) > 500
    target = 'f"s3a://{S3_BUCKET}/{S3_BASE_PATH}/{uuid.uuid4()}/"'
    rows = texts(spark, scripts).repartition(8).select(
        "id", dr.called_literals("text").alias("found"), dr.rewrite_calls("text").alias("changed")
    )
    for row in rows.collect():
        script = scripts[row.id]
        # The parser gives line ends as it reads them.
        assert [x.replace("\r\n", "\n") for x in row.found] == parsed_calls(script)
        assert row.changed.count(target) == len(row.found)
        restored = row.changed
        for literal in row.found:
            restored = restored.replace(target, literal, 1)
        assert restored == script


BROKEN_SCRIPTS = [
    'a.parquet("x', "f'{", 'f"{x', ")))", "\\", "\'\'\'", 'a.parquet("x"', '}}"a"{{', "f'{x:}}}}' {{ ((", "",
    "x = 'a\na.parquet('y')",
]


def test_broken_scripts_do_no_harm(spark):
    df = texts(spark, BROKEN_SCRIPTS)
    rows = df.select("text", dr.called_literals("text").alias("found"), dr.rewrite_calls("text").alias("changed"))
    for row in rows.collect():
        assert row.found == (["'y'"] if "'y'" in row.text else [])
        assert row.found or row.changed == row.text


@pytest.mark.parametrize(
    "text",
    [
        'f"{x}"' * 20_000, '(a.parquet(("x")))\n' * 10_000, "f'{" * 20_000, "a.parquet((" * 20_000,
        'f"' + "x" * 10**6 + '"',
    ],
    ids=["fields", "calls", "open fields", "open calls", "long"],
)
def test_long_scanned_texts(spark, text):
    """Linear: these take some seconds, a quadratic scan would take many minutes."""
    began = time.time()
    found = texts(spark, [text]).select(F.size(dr.called_literals("text"))).first()[0]
    assert found == (10_000 if text.startswith("(a.") else 0)
    assert time.time() - began < 60


def test_golden_calls(spark):
    rows = dr.call_literals(texts(spark, [EXPORTS, NIGHTLY, "nothing"]), "text").orderBy("id", "pos").collect()
    assert [tuple(row) for row in rows] == [
        (0, 0, "exports/fixed.parquet", "fixed"),
        (0, 1, "exports/fixed.parquet", "fixed"),
    ]


def test_call_contents_are_what_the_parser_reads(spark):
    df = dr.call_literals(texts(spark, CALL_SCRIPTS), "text").orderBy("id", "pos")
    found = [(row.id, row.literal) for row in df.collect()]
    expected = [
        (i, ast.literal_eval(f"({call})"))
        for i, script in enumerate(CALL_SCRIPTS)
        for call in parsed_calls(script)
    ]
    # Escapes stay as they are written.
    assert [(i, literal.replace("\\'", "'")) for i, literal in found] == expected


def test_call_destinations_are_unique(spark):
    df = dr.call_literals(
        texts(spark, [EXPORTS] * 50), "text", destination=dr.unique_path("b", "base")
    )
    found = [row.destination for row in df.collect()]
    assert len(found) == len(set(found)) == 100


@pytest.mark.parametrize("script", CALL_SCRIPTS)
def test_rewritten_calls_change_nothing_else(spark, script):
    changed = texts(spark, [script]).select(dr.rewrite_calls("text")).first()[0]
    target = 'f"s3a://{S3_BUCKET}/{S3_BASE_PATH}/{uuid.uuid4()}/"'
    assert changed.count(target) == len(parsed_calls(script))
    assert parsed_calls(changed) == []
    restored = changed
    for literal in parsed_calls(script):
        restored = restored.replace(target, literal, 1)
    assert restored == script


HEADS = [
    "",
    "# -*- coding: utf-8 -*-\n\n",
    '"""What this is."""\n',
    "#!/usr/bin/env python\n# note: import uuid\n'''Two\nlines.'''  # why\nfrom __future__ import annotations\n",
    "'one' 'part'\n\nfrom __future__ import (\n    annotations,\n    division,\n)\n\n# then\n",
    "import os, uuid\n",
    "import uuid as u\nfrom uuid import uuid4\n",
    "S3_BUCKET = 'mine'\n",
    "other = S3_BASE_PATH = 'there'\nimport uuid; import os\n",
    '"""\nimport uuid\nS3_BUCKET = 1\n"""\n',
    "S3_BUCKETS = 1\nif S3_BUCKETS == 1:\n    import uuid\n",
    "S3_BUCKET: str = 'mine'\r\n",
]
BODIES = ['a = b.read.parquet("x/y.parquet")\n', "a = b.parquet('x')", "a = 1\n", "'x.y'.strip()\na = b.parquet('x')"]


def module_names(script):
    """Names that the statements of a module itself bind."""
    bound = set()
    for node in ast.parse(script).body:
        if isinstance(node, ast.Import):
            bound |= {alias.asname or alias.name for alias in node.names}
        elif isinstance(node, ast.Assign):
            bound |= {target.id for target in node.targets if isinstance(target, ast.Name)}
        elif isinstance(node, ast.AnnAssign):
            bound.add(node.target.id)
    return bound


@pytest.mark.parametrize("head", HEADS)
def test_rewritten_scripts_name_nothing_undefined(spark, head):
    scripts = [head + body for body in BODIES]
    df = texts(spark, scripts).select(
        "text",
        dr.rewrite_calls("text").alias("plain"),
        dr.rewrite_calls("text", definitions=("a bucket", "it's/here")).alias("defined"),
    )
    for text, plain, defined in df.collect():
        if plain == text:
            assert defined == text
            continue
        module = ast.parse(defined)
        assert {"uuid", "S3_BUCKET", "S3_BASE_PATH"} <= module_names(defined)
        # What was missing, in one place, and all else as before.
        lines = {
            "uuid": "import uuid\n",
            "S3_BUCKET": "S3_BUCKET = 'a bucket'\n",
            "S3_BASE_PATH": "S3_BASE_PATH = \"it's/here\"\n",
        }
        added = "".join(line for name, line in lines.items() if name not in module_names(plain))
        places = [k for k in range(len(plain) + 1) if plain[:k] + added + plain[k:] == defined]
        assert places and places[0] <= plain.index("{uuid.uuid4()}")
        assert ast.get_docstring(module, clean=False) == ast.get_docstring(ast.parse(plain), clean=False)


def test_no_call_no_definitions(spark):
    df = texts(spark, [None, "", "x = 1", "# a.parquet('x')"])
    for text, defined in df.select("text", dr.rewrite_calls("text", definitions=("b", "p"))).collect():
        assert defined == text


def test_other_columns_stay_and_text_goes(spark):
    df = texts(spark, ["'a'"]).withColumn("odd.name", F.lit(1))
    assert dr.quoted_literals(df, "text").columns == ["id", "odd.name", "pos", "quote", "literal"]


@pytest.mark.parametrize(
    "text",
    ['x="' + "ab/" * 100_000 + '"', "'" * 100_001, "\"'" * 100_000 + "\n", "'" + "\\'😀a" * 50_000 + "'", '"""' + "a.b" * 100_000],
    ids=["long literal", "quotes", "mixed quotes", "escapes", "unterminated"],
)
def test_long_texts(spark, text):
    df = texts(spark, [text]).select(
        dr.quoted("text").alias("q"), dr.rewrite_literals("text", "b", "r"), dr.rewrite_calls("text")
    )
    found, _, calls_changed = df.first()
    assert found == [m.group(0) for m in re.finditer(QUOTED, text)]
    assert calls_changed == text


def test_clip(spark):
    rows = texts(spark, ["é" * 100, "é" * 101, "", None]).select(dr.clip("text")).collect()
    assert [row[0] for row in rows] == ["é" * 100, "é" * 100 + "...", "", None]
    assert texts(spark, ["abcd"]).select(dr.clip("text", 3)).first()[0] == "abc..."
