"""Path functions: golden values, brute force against the definitions, plans."""

import itertools
import os.path
import re
import time
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import dataroute as dr
from dataroute.functions import paths
from dataroute.queries.sql_side import LAST_PART

# --- Fixed values: paths and the names they must have -----------------------------
# path, name before the last dot, name before the first dot, slug
GOLDEN = [
    ("s3://bucket/tabela_padrao.parquet", "tabela_padrao", "tabela_padrao", "tabela_padrao_parquet"),
    ("{work_space}/porcetagem_correta.parquet", "porcetagem_correta", "porcetagem_correta", "porcetagem_correta_parquet"),
    ("outro_bucket/subpasta/arquivo_final.csv", "arquivo_final", "arquivo_final", "arquivo_final_csv"),
    ("arquivo_local.txt", "arquivo_local", "arquivo_local", "arquivo_local_txt"),
    ("/caminho/absoluto/no/linux/script.sh", "script", "script", "script_sh"),
    ("C:\\caminho\\windows\\relatorio.docx", "C:\\caminho\\windows\\relatorio", "C:\\caminho\\windows\\relatorio", "C:\\caminho\\windows\\relatorio_docx"),
    ("nome_sem_caminho.json", "nome_sem_caminho", "nome_sem_caminho", "nome_sem_caminho_json"),
    ("arquivo.com.multiplos.pontos.zip", "arquivo.com.multiplos.pontos", "arquivo", "arquivo_com_multiplos_pontos_zip"),
    (".arquivo_oculto.ini", ".arquivo_oculto", "arquivo_oculto", "_arquivo_oculto_ini"),
    ("dados/entrada/F8.TBLR.data", "F8.TBLR", "F8", "F8_TBLR_data"),
    ("outros_dados/ARQ.TIPO_X.VERSAO_1.bkp", "ARQ.TIPO_X.VERSAO_1", "ARQ", "ARQ_TIPO_X_VERSAO_1_bkp"),
    ("arquivos/F8_TBLR_ja_existe.log", "F8_TBLR_ja_existe", "F8_TBLR_ja_existe", "F8_TBLR_ja_existe_log"),
    ("apenas_um_arquivo", None, None, "apenas_um_arquivo"),
    ("pasta/outra_pasta/", None, None, "outra_pasta/"),
    ("", None, None, None),
    (None, None, None, None),
    ("s3://meu-data-lake/vendas/dia_2023_12_25.parquet", "dia_2023_12_25", "dia_2023_12_25", "dia_2023_12_25_parquet"),
    ("s3://relatorios/mensal/VENDAS.JULHO.2024.csv", "VENDAS.JULHO.2024", "VENDAS", "VENDAS_JULHO_2024_csv"),
    ("{work_space}/dados_brutos/F8.QUERY_FOR_TBF8DPR5_DIARIO", "F8", "F8", "F8_QUERY_FOR_TBF8DPR5_DIARIO"),
    ("/path/to/.config", "to/", "to/", "_config"),
    ("dir.v1/file", None, None, "file"),
    ("a.b/c.d", "c", "c", "c_d"),
    ("x.", "x", "x", "x_"),
    ("/", None, None, "/"),
    ("a\nb/c.csv", "c", "a\nb/c", "c_csv"),
    ("tail.csv\n", "tail", "tail", "tail_csv"),
]

# path, strict, flexible, basename
GOLDEN_RULES = [
    ("s3://bucket/tabela_padrao.parquet", "tabela_padrao", "tabela_padrao", "tabela_padrao"),
    ("{work_space}/F8.TBLR.data", "F8", "F8", "F8_TBLR"),
    ("dados/relatorio.v2.csv", "relatorio", "relatorio", "relatorio_v2"),
    ("arquivo_sem_extensao", None, "arquivo_sem_extensao", "arquivo_sem_extensao"),
    ("/path/to/.config", "to/", "to/", "_config"),
    ("pasta/", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
    ("C:\\windows\\system.ini", "C:\\windows\\system", "C:\\windows\\system", "C:\\windows\\system"),
    ("docs/README", None, "README", "README"),
    ("images/logo.jpeg", "logo", "logo", "logo"),
    ("special_reports/F8.TBLR_final.log", "F8", "F8", "F8_TBLR_final"),
]
# ----------------------------------------------------------------------------------


def evaluate(spark, strings, *columns):
    df = spark.createDataFrame([(s,) for s in strings], "path string")
    return [tuple(row) for row in df.select("path", *columns).collect()]


def defined(rule, path):
    found = re.search(rule, path or "")
    return found.group(1) if found else None


def defined_by_rules(path, rules):
    """The rule walk in plain Python, as the expected value."""
    names = (defined(rule, path) for rule in rules)
    name = next((n for n in names if n and n not in (".", "..")), None)
    return name and os.path.splitext(name)[0].replace(".", "_")


def every_string(alphabet, length):
    for n in range(1, length + 1):
        yield from map("".join, itertools.product(alphabet, repeat=n))


def test_golden_names(spark):
    rows = evaluate(
        spark,
        [row[0] for row in GOLDEN],
        dr.base_name("path"),
        dr.base_name_first_dot("path"),
        dr.file_slug("path"),
    )
    assert rows == GOLDEN


def test_golden_rules(spark):
    rows = evaluate(
        spark,
        [row[0] for row in GOLDEN_RULES],
        dr.base_name_by_rules("path", dr.RULES_STRICT),
        dr.base_name_by_rules("path", dr.RULES_FLEXIBLE),
        dr.base_name_by_rules("path", dr.RULES_BASENAME),
    )
    assert rows == GOLDEN_RULES


def test_linear_forms_equal_the_definitions(spark):
    """All strings over the characters that matter, newlines included."""
    strings = list(every_string("a./\n", 7))
    rows = evaluate(
        spark,
        strings,
        dr.base_name("path"),
        dr.base_name_first_dot("path"),
        dr.file_slug("path"),
        dr.strip_extension("path"),
    )
    for path, last_dot, first_dot, slug, stem in rows:
        assert last_dot == defined(paths.RULE_LAST_DOT, path), repr(path)
        assert first_dot == defined(paths.RULE_FIRST_DOT, path), repr(path)
        expected = defined(LAST_PART, path)
        assert slug == (expected and expected.replace(".", "_")), repr(path)
        assert stem == os.path.splitext(path)[0], repr(path)
        assert dr.redirect_location(path, "r", "i") == (
            path if first_dot is None else f"r/i/tmp/{first_dot}.parquet"
        )


def test_rules_equal_the_definitions(spark):
    pieces = ["F8.TBLR", "F8", ".", "..", "/", "a", "\n"]
    strings = ["".join(parts) for n in (1, 2, 3, 4) for parts in itertools.product(pieces, repeat=n)]
    rule_sets = [
        dr.RULES_STRICT,
        dr.RULES_FLEXIBLE,
        dr.RULES_BASENAME,
        [r"(F\d)?(x)?", r"/(\w+)", paths.RULE_PLAIN_NAME],
    ]
    rows = evaluate(
        spark, strings, *[dr.base_name_by_rules("path", rules) for rules in rule_sets]
    )
    for path, *names in rows:
        assert names == [defined_by_rules(path, rules) for rules in rule_sets], repr(path)


ENDING_RULES = [
    r"(?:.*/)?(.+)\.c$",
    r"(?:.*/)?([^/]+)\.c$",
    r"(?:.*/)?([^.]+)c$",
    r"(?:.*/)?(\w+)/c$",
    r"(?:.*/)?([a.]+)$",
    r"(?:.*/)?([/c]+)a$",
    r"(?:.*/)?(\W+)\.\.$",
]


@pytest.mark.parametrize("rule", ENDING_RULES)
def test_ending_rules_equal_the_definitions(spark, rule):
    """All short strings: the linear form on paths of one line, the rule itself on others."""
    strings = [*every_string("ac./\n", 6), "é/😀é.c", "a/é😀/c"]
    rows = evaluate(
        spark, strings, dr.base_name_by_rules("path", [rule]), dr.base_name_by_rules("path", [rule], bounded=True)
    )
    for path, name, bounded in rows:
        expected = defined_by_rules(path, [rule])
        assert name == expected, repr(path)
        assert bounded == (None if "\n" in path else expected), repr(path)


@pytest.mark.parametrize("rule", [r"(?:.*/)?(.+)\.csv$", r"(?:.*/)?([^/]+)\.csv$", r"(?:.*/)?(\w+)\.csv$"])
@pytest.mark.parametrize("path", ["a/" * 500_000, "data:" + "x" * 10**6, "a/" * 500_000 + "/.csv", ".csv" * 250_000])
def test_ending_rules_take_linear_time(spark, rule, path):
    began = time.time()
    evaluate(spark, [path] * 3, dr.base_name_by_rules("path", [rule], bounded=True))
    assert time.time() - began < 20


def test_unbounded_rules_are_refused_on_demand():
    for rule in (r"(.+)\.csv$", r"(?:.*/)?(.+)\.c.v$", r"(?:.*/)?(.+)(a|b)$", r"(?:.*/)?(.+)\.[^/]*x$", r"(?:.*/)?(a+b+)$"):
        with pytest.raises(ValueError, match="linear"):
            dr.base_name_by_rules("path", [rule], bounded=True)
        dr.base_name_by_rules("path", [rule])
    dr.base_name_by_rules("path", [*dr.RULES_FLEXIBLE, "no group", *ENDING_RULES], bounded=True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.é😀/\n\\{}", max_size=30))
def test_driver_side_pattern_equals_the_definition(path):
    base = defined(paths.RULE_FIRST_DOT, path)
    expected = path if base is None else f"s3://b/r/tmp/{base}.parquet"
    assert dr.redirect_location(path, "s3://b", "r") == expected


def test_unusable_rules_are_skipped(spark):
    strict = dr.RULES_STRICT[0]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        rows = evaluate(
            spark,
            ["x/name.csv"],
            dr.base_name_by_rules("path", []),
            dr.base_name_by_rules("path", ["(", strict]),
            dr.base_name_by_rules("path", ["[a-z]+", strict]),
            dr.base_name_by_rules("path", ["[a-z]+"]),
        )
    assert rows == [("x/name.csv", None, "name", "name", None)]
    assert any("is skipped" in str(w.message) for w in caught)


def test_redirect_agrees_with_driver_and_is_stable(spark):
    strings = [row[0] for row in GOLDEN if row[0]] + ["/path/to/.config"]
    once = dr.redirect_path("path", "b", "r1")
    rows = evaluate(spark, strings, once, dr.redirect_path(once, "b", "r1"))
    for path, destination, again in rows:
        assert destination == dr.redirect_location(path, "s3://b", "r1")
        if "\n" not in path and not path.endswith("/.config"):
            assert again == destination


def test_unmatched_paths_can_become_null(spark):
    column = dr.redirect_path("path", "b", "r1", keep_unmatched=False)
    assert evaluate(spark, ["docs/README"], column) == [("docs/README", None)]


@pytest.mark.parametrize("bucket, run_id", [("", "r"), ("b", ""), (None, "r")])
def test_empty_names_are_errors(bucket, run_id):
    with pytest.raises(ValueError):
        dr.redirect_path(F.lit("x"), bucket, run_id)
    with pytest.raises(ValueError):
        dr.redirect_location("x", bucket, run_id)


def test_unique_paths_differ(spark):
    df = spark.range(1000).select(dr.unique_path("b", "base", ".parquet", "s3://").alias("p"))
    found = [row.p for row in df.collect()]
    assert len(set(found)) == 1000
    shape = re.compile(r"s3://b/base/[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\.parquet")
    assert all(shape.fullmatch(p) for p in found)


LINES = {
    "dotted lines": "a.b\n" * 20_000 + "/x/.y",
    "lines and a slash": "ab\n" * 20_000 + "x/",
    "slashed lines": "a/.\n" * 20_000 + "/",
}


@pytest.mark.parametrize("times", [1, 2, 4])
@pytest.mark.parametrize("text", LINES.values(), ids=LINES)
def test_long_paths_of_many_lines_take_linear_time(spark, text, times):
    path = text * times
    columns = (
        dr.base_name("path"), dr.file_slug("path"), dr.base_name_by_rules("path", dr.RULES_FLEXIBLE),
    )
    evaluate(spark, ["warm/up.x\ny"], *columns)
    start = time.perf_counter()
    evaluate(spark, [path], *columns)
    assert time.perf_counter() - start < 1


@pytest.mark.parametrize(
    "text",
    ["a/" * 100_000, "a." * 100_000 + "/x", "a.b/" * 60_000 + "/.x", "x" * 200_000, "\n" * 100_000 + ".x"],
    ids=["slashes", "dots", "hidden", "plain", "newlines"],
)
def test_long_paths_take_linear_time(spark, text):
    """The unanchored definitions take up to cubic time for these."""
    ((path, *_),) = evaluate(
        spark,
        [text],
        dr.base_name("path"),
        dr.base_name_first_dot("path"),
        dr.file_slug("path"),
        dr.strip_extension("path"),
        dr.base_name_by_rules("path", dr.RULES_FLEXIBLE),
    )
    assert path == text
