"""The same results in SQL, from the defining regexes, for DuckDB.

The Spark side uses linear-time forms of these regexes, so the comparison also
checks that the two forms agree.
"""

from __future__ import annotations

from dataroute.queries.inputs import (
    LINE_PATH,
    ORDER_PATH,
    ORDER_PATH_LINES,
    PART_JOB,
    PART_PATH,
    PART_SCRIPT,
)

# --- Fixed values: defining regexes, written out apart from the library's -----
RULE_FIRST_DOT = r"(?:.*/)?([^.]+)\.[^/]*$"
RULE_LAST_DOT = r"(?:.*/)?(.+)\.[^/]*$"
RULE_SPECIAL_NAME = r"(?:.*/)?(F8\.TBLR)\.[^/]*$"
RULE_PLAIN_NAME = r"(?:.*/)?([^/]+)$"
LAST_PART = r"(?:.*/)?(.+)[^/]*$"
EXTENSION = r"(?s)^((?:.*/)?\.*[^/.][^/]*?)\.[^./]*$"
QUOTED = r""""[^\n][^"\n]*"|'[^\n][^'\n]*'"""
# ------------------------------------------------------------------------------

PREFIX = "s3://b/r1/tmp/"
PART_PATHS = f"(SELECT p_partkey, {PART_PATH} AS path FROM part)"
ORDER_PATHS = f"(SELECT o_orderkey, {ORDER_PATH} AS path FROM orders)"
SCRIPTS = f"(SELECT p_partkey, {PART_SCRIPT} AS code FROM part)"

_STRING = (
    r'"""(?s:.*?)"""' + r"|'''(?s:.*?)'''"
    r'|"(?:[^"\\\n]|\\(?s:.))*"' + r"|'(?:[^'\\\n]|\\(?s:.))*'"
)
CALLS = rf"\.\s*parquet\s*\(\s*[uUrR]?({_STRING})\s*[,)]|#[^\n]*|{_STRING}"
CALL_TARGET = 'f"s3a://{S3_BUCKET}/{S3_BASE_PATH}/{uuid.uuid4()}/"'


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def named(rule: str, path: str) -> str:
    return f"nullif(regexp_extract({path}, {text(rule)}, 1), '')"


def slug(path: str) -> str:
    return f"replace({named(LAST_PART, path)}, '.', '_')"


def without_extension(name: str) -> str:
    return rf"regexp_replace({name}, {text(EXTENSION)}, '\1')"


def by_rules(path: str, *rules: str) -> str:
    names = [f"nullif(nullif({named(rule, path)}, '.'), '..')" for rule in rules]
    return f"replace({without_extension(f'coalesce({", ".join(names)})')}, '.', '_')"


def target(path: str) -> str:
    return f"{text(PREFIX)} || {named(RULE_FIRST_DOT, path)} || '.parquet'"


def on_url(name: str) -> str:
    return f"SELECT page_id, {name} AS name FROM pages"


def on_path(name: str) -> str:
    return f"SELECT o_orderkey, path, {name} AS name FROM {ORDER_PATHS}"


def on_lines(name: str) -> str:
    return f"SELECT o_orderkey, {name} AS name FROM (SELECT o_orderkey, {ORDER_PATH_LINES} AS path FROM orders)"


def on_part_path(name: str) -> str:
    return f"SELECT p_partkey, path, {name} AS name FROM {PART_PATHS}"


def literals(key: str, column: str, source: str) -> str:
    return f"""
        SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, left(found[i], 1) AS quote,
               substr(found[i], 2, length(found[i]) - 2) AS literal
        FROM (SELECT {key}, found, unnest(range(1, len(found) + 1)) AS i
              FROM (SELECT {key},
                           regexp_extract_all({column}, {text(QUOTED)}) AS found
                    FROM {source}))
    """


def rewritten(key: str, column: str, source: str) -> str:
    content = "substr(found[i], 2, length(found[i]) - 2)"
    quote = "left(found[i], 1)"
    return f"""
        SELECT {key}, array_to_string(list_transform(range(1, len(gaps) + 1),
            lambda i: gaps[i] || coalesce(
                {quote} || {target(content)} || {quote}, found[i], '')), '') AS {column}
        FROM (SELECT {key}, regexp_split_to_array({column}, {text(QUOTED)}) AS gaps,
                     regexp_extract_all({column}, {text(QUOTED)}) AS found
              FROM {source})
    """


def inventory(key: str, column: str, source: str) -> str:
    return f"""
        SELECT base, count(DISTINCT {key}) AS n_texts, count(*) AS n_literals
        FROM (SELECT {key}, {named(RULE_FIRST_DOT, 'literal')} AS base
              FROM ({literals(key, column, source)}))
        WHERE base IS NOT NULL GROUP BY base
    """


def collisions(source: str) -> str:
    return f"""
        SELECT destination, count(DISTINCT path) AS n_paths, count(*) AS n_rows
        FROM (SELECT path, coalesce({target('path')}, path) AS destination
              FROM {source})
        GROUP BY destination HAVING count(DISTINCT path) > 1
    """


def shape(setup: str, source: str, table: str, n_cols: int) -> str:
    return (
        f"SELECT {text(setup)} AS setup, {text(source)} AS source, "
        f"count(*) AS n_rows, {n_cols} AS n_cols FROM {table}"
    )


def together(selects: list[str]) -> str:
    return " UNION ALL ".join(selects)


COLUMN_COUNTS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6,
    "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3,
    "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}

CUSTOMER_RECORD = """
    CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name,
                  'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal,
                  'c_mktsegment': c_mktsegment}) AS VARCHAR)
"""

REWRITTEN_CALLS = f"""
    SELECT p_partkey, array_to_string(list_transform(range(1, len(gaps) + 1),
        lambda i: gaps[i] || coalesce(CASE
            WHEN named[i] <> '' THEN replace(found[i], named[i], {text(CALL_TARGET)})
            ELSE found[i] END, '')), '') AS code
    FROM (SELECT p_partkey, regexp_split_to_array(code, {text(CALLS)}) AS gaps,
                 regexp_extract_all(code, {text(CALLS)}) AS found,
                 regexp_extract_all(code, {text(CALLS)}, 1) AS named
          FROM {SCRIPTS})
"""
# In the jobs f-strings nest two deep, and brackets hold a literal three deep.
JOBS = f"(SELECT p_partkey, {PART_JOB} AS code FROM part)"
JOB_CALL = (
    r'(read|write)(?:\.mode\([^()]*\)|\.mode\(f"[^\n]*?write"\))?\.(parquet|csv|json)(\((?:\s|\\|\()*)("[^"\n]*")\)*[,)\n]'
)
JOB_ACCESSES = f"""
    SELECT p_partkey, i - 1 AS pos, regexp_extract(found[i], {text(JOB_CALL)}, 1) AS role,
           regexp_extract(found[i], {text(JOB_CALL)}, 2) AS method,
           regexp_extract(found[i], {text(JOB_CALL)}, 3) AS opening,
           regexp_extract(found[i], {text(JOB_CALL)}, 4) AS literal
    FROM (SELECT p_partkey, found, unnest(range(1, len(found) + 1)) AS i
          FROM (SELECT p_partkey, list_filter(
                           regexp_extract_all(regexp_replace(code, '\n#[^\n]*', '', 'g'), {text(JOB_CALL)}),
                           lambda x: NOT contains(x, '/skipped/')) AS found
                FROM {JOBS}))
"""
JOB_USES = f"""
    SELECT p_partkey, CAST(pos AS INTEGER) AS pos, role, substr(literal, 2, length(literal) - 2) AS literal,
           coalesce({target("substr(literal, 2, length(literal) - 2)")}, literal) AS destination
    FROM ({JOB_ACCESSES})
"""
JOB_USE = f"""
    SELECT destination, count(DISTINCT p_partkey) FILTER (role = 'write') AS n_writers,
           count(DISTINCT p_partkey) FILTER (role = 'read') AS n_readers
    FROM ({JOB_USES}) GROUP BY destination
"""

# \1 is the first line.
DEFINED = "\\1import uuid\nS3_BUCKET = 'bucket'\nS3_BASE_PATH = 'base'\n"

ORACLES = {
    "a1_scan_parquet": "SELECT * FROM lineitem",
    "a2_csv_roundtrip": "SELECT * FROM customer",
    "a2_csv_strings": """
        SELECT CAST(o_orderkey AS VARCHAR) AS _c0, CAST(o_custkey AS VARCHAR) AS _c1,
               o_orderstatus AS _c2, CAST(o_totalprice AS VARCHAR) AS _c3,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS _c4,
               o_orderpriority AS _c5 FROM orders
    """,
    "a3_json_roundtrip": "SELECT * FROM pages",
    "a3_json_inferred": """
        SELECT doc_id, CAST(quality AS BIGINT) AS quality,
               CAST(toxic AS BIGINT) AS toxic FROM labels
    """,
    "a4_load_roundtrip": "SELECT * FROM part",
    "a5_view_scan": "SELECT * FROM customer",
    "b1_mode_overwrite": "SELECT * FROM supplier",
    "b1_mode_append": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "b1_append_more": """
        SELECT *, CAST(NULL AS INTEGER) AS c_extra FROM customer
        UNION ALL BY NAME SELECT *, CAST(length(c_name) AS INTEGER) AS c_extra FROM customer
    """,
    "b1_append_fewer": """
        SELECT * FROM customer UNION ALL BY NAME SELECT * EXCLUDE c_acctbal FROM customer
    """,
    "b1_append_wider": """
        SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer
        UNION ALL BY NAME SELECT * REPLACE (c_nationkey + 5000000000 AS c_nationkey) FROM customer
    """,
    "b1_append_narrower": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "b1_mode_ignore": "SELECT * FROM customer",
    "b1_mode_error": "SELECT *, 'PATH_ALREADY_EXISTS' AS outcome FROM customer",
    "b2_csv_save": "SELECT * FROM supplier",
    "b3_json_save": "SELECT * FROM orders",
    "b4_format_roundtrip": "SELECT * FROM events",
    "b5_records": f"SELECT {CUSTOMER_RECORD} AS record FROM customer",
    "b5_records_text": """
        SELECT CAST(to_json({'conv_id': conv_id, 'turn': turn, 'role': role,
                             'text': text}) AS VARCHAR) AS record
        FROM conversations
    """,
    "b5_records_typed": "SELECT * FROM orders",
    "b5_records_nested": """
        SELECT CAST(to_json({
                   'event_id': event_id,
                   'day': strftime(ts, '%Y-%m-%dT00:00:00.000'),
                   'who': {'user_id': user_id, 'kind': event_type},
                   'gone': [NULL, NULL],
                   'when': {'at': strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')},
                   'measured': [{'value': value, 'props': props}]
               }) AS VARCHAR) AS record
        FROM events
    """,
    "b5_records_maps": """
        SELECT CAST(to_json({
                   'event_id': event_id,
                   'by_day': MAP {strftime(ts, '%Y-%m-%dT00:00:00.000'): user_id},
                   'by_time': MAP {strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'):
                                   MAP {event_type: strftime(ts, '%Y-%m-%dT00:00:00.000')}}
               }) AS VARCHAR) AS record
        FROM events
    """,
    "b6_unique_sink": """
        SELECT *, 1 AS copy FROM customer UNION ALL SELECT *, 2 AS copy FROM customer
    """,
    "b7_redirect_roundtrip": "SELECT * FROM orders",
    "b7_redirect_literal_names": together([
        f"SELECT '{path}' AS path, count(*) AS n_rows, {n} AS n_cols FROM {name}"
        for path, name, n in [
            ("/a/b*c.csv", "orders", 6), ("/a/bXc.csv", "customer", 5),
            ("part[1].csv", "supplier", 4), ("{ws}.csv", "nation", 3),
        ]
    ]),
    "b8_replace_stale": "SELECT * FROM customer",
    "c1_resolve_order": together([
        shape("parquet", "parquet", "orders", 6),
        shape("parquet, view", "parquet", "orders", 6),
        shape("parquet, dataframe", "parquet", "orders", 6),
        shape("parquet, view, dataframe", "parquet", "orders", 6),
        shape("view", "view", "customer", 5),
        shape("view, dataframe", "view", "customer", 5),
        shape("two views, dataframe", "direct_dataframe", "part", 6),
        shape("dataframe", "direct_dataframe", "part", 6),
    ]),
    "c2_new_views": together([
        shape("replaced", "direct_dataframe", "part", 6),
        shape("one new", "view", "customer", 5),
        shape("two new", "direct_dataframe", "part", 6),
    ]),
    "c3_output_fallback": "SELECT * FROM orders",
    "c3_partitioned_output": "SELECT * FROM orders",
    "c4_shape": together([
        f"SELECT '{name}' AS name, count(*) AS n_rows, {n} AS n_cols FROM {name}"
        for name, n in COLUMN_COUNTS.items()
    ]),
    "c5_audit": together([
        f"""SELECT '{name}' AS name, 'success' AS status, 'parquet' AS result_source,
                   '{name}.parquet' AS locator, count(*) AS n_rows, {n} AS n_cols,
                   CAST(NULL AS VARCHAR) AS error_message FROM {name}"""
        for name, n in COLUMN_COUNTS.items()
    ] + ["SELECT 'nothing', 'success', 'none', NULL, NULL, NULL, NULL"]),
    "c5_run_log": """
        SELECT 'good' AS name, 'success' AS status, 'direct_dataframe' AS result_source,
               count(*) AS n_rows, 6 AS n_cols FROM orders
        UNION ALL SELECT 'empty', 'success', 'none', NULL, NULL
        UNION ALL SELECT 'repeated', 'error', 'json_serialization_error', NULL, NULL
        UNION ALL SELECT 'records', 'success', 'text', count(*), 1 FROM orders
    """,
    "c5_taken_target": """
        SELECT 'first' AS name, 'success' AS status, 'direct_dataframe' AS result_source,
               count(*) AS n_rows, 'PATH_ALREADY_EXISTS' AS raised FROM orders
        UNION ALL SELECT 'second', 'error', 'direct_dataframe', NULL, 'PATH_ALREADY_EXISTS'
    """,
    "c5_run_job": """
        SELECT 'saves' AS name, 'success' AS status, 'parquet' AS result_source,
               count(*) AS n_rows, 6 AS n_cols,
               CAST(NULL AS VARCHAR) AS error_message, count(*) AS n_records
        FROM orders WHERE o_orderkey > 1
        UNION ALL
        SELECT 'names_a_view', 'success', 'view', count(*), 5, NULL, count(*)
        FROM customer
        UNION ALL
        SELECT 'returns', 'success', 'direct_dataframe', count(*), 11, NULL, count(*)
        FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL
        SELECT 'fails', 'error', 'none', NULL, NULL,
               'ValueError: the job fails after saving', NULL
    """,
    "c6_preview": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id,
               CASE WHEN length(text) > 100 THEN left(text, 100) || '...'
                    ELSE text END AS text,
               lang, source, CAST(n_chars AS VARCHAR) AS n_chars
        FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 20)
    """,
    "d1_project": "SELECT o_orderkey, o_totalprice FROM orders",
    "d2_filter": "SELECT * FROM orders WHERE o_orderkey > 1",
    "d3_stringify": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
               CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
               CAST(o_totalprice AS VARCHAR) AS o_totalprice,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
        FROM orders
    """,
    "d4_clip": """
        SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...'
                            ELSE text END AS clipped FROM documents
    """,
    "d5_keep_original": f"""
        SELECT o_orderkey, coalesce({target('path')}, path) AS kept,
               {target('path')} AS target FROM {ORDER_PATHS}
    """,
    "e1_join_using": """
        SELECT * FROM (SELECT * RENAME (o_custkey AS custkey) FROM orders)
        JOIN (SELECT * RENAME (c_custkey AS custkey) FROM customer) USING (custkey)
    """,
    "f1_base_name": on_path(named(RULE_LAST_DOT, "path")),
    "f1_base_name_url": on_url(named(RULE_LAST_DOT, "url")),
    "f1_base_name_lines": on_lines(named(RULE_LAST_DOT, "path")),
    "f2_base_name_first_dot": on_path(named(RULE_FIRST_DOT, "path")),
    "f2_base_name_first_dot_url": on_url(named(RULE_FIRST_DOT, "url")),
    "f3_file_slug": on_path(slug("path")),
    "f3_file_slug_url": on_url(slug("url")),
    "f3_file_slug_lines": on_lines(slug("path")),
    "f4_rules_strict": on_path(by_rules("path", RULE_FIRST_DOT)),
    "f4_rules_flexible": on_path(
        by_rules("path", RULE_SPECIAL_NAME, RULE_LAST_DOT, RULE_PLAIN_NAME)
    ),
    "f4_rules_basename": on_path(by_rules("path", RULE_PLAIN_NAME)),
    "f4_rules_custom": on_path(by_rules("path", r"/(c\d+)/\.", r"c(\d*5)\b")),
    "f4_rules_bounded": on_path(
        by_rules("path", r"(?:.*/)?(.+)\.json$", r"(?:.*/)?([^/]+)\.csv$", r"(?:.*/)?([a-z.]+)$")
    ),
    "f5_strip_extension": on_path(without_extension("path")),
    "f5_strip_extension_part": on_part_path(without_extension("path")),
    "f7_redirect": on_part_path(f"coalesce({target('path')}, path)"),
    "f8_unique_path": """
        SELECT count(*) AS n_rows, count(*) AS n_distinct, count(*) AS n_well_formed
        FROM orders
    """,
    "g1_literals": literals("page_id", "html", "pages"),
    "g1_literals_documents": literals("doc_id", "text", "documents"),
    "g2_rewrite": rewritten("page_id", "html", "pages"),
    "g2_rewrite_scripts": rewritten("p_partkey", "code", SCRIPTS),
    "g3_calls": f"""
        SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, literal,
               {named(RULE_FIRST_DOT, 'literal')} AS base
        FROM (SELECT p_partkey, i, substr(found[i], 2, length(found[i]) - 2) AS literal
              FROM (SELECT p_partkey, found, unnest(range(1, len(found) + 1)) AS i
                    FROM (SELECT p_partkey, list_filter(
                                     regexp_extract_all(code, {text(CALLS)}, 1),
                                     lambda x: x <> '') AS found
                          FROM {SCRIPTS})))
    """,
    "g3_calls_scanned": f"""
        SELECT p_partkey,
               CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1 AS INTEGER) AS pos,
               substr(literal, 2, length(literal) - 2) AS literal,
               {named(RULE_FIRST_DOT, "substr(literal, 2, length(literal) - 2)")} AS base
        FROM ({JOB_ACCESSES}) WHERE method = 'parquet'
    """,
    # Three kinds of opening before a literal; the two calls that do not count stay.
    "g4_rewrite_scanned": f"""
        SELECT p_partkey, replace(replace(regexp_replace(
                   replace(replace(code, '"/skipped/', '"|skipped/'), '#', '|#'),
                   '(\n[abcd][^|\n]*[.]parquet[(](?:[(])*)"/[^"\n]*"', {text(chr(92) + "1" + CALL_TARGET)}, 'g'),
                   '"|skipped/', '"/skipped/'), '|#', '#') AS code
        FROM {JOBS}
    """,
    "b7_script_accesses": f"""
        SELECT p_partkey AS script, pos, role, literal, destination FROM ({JOB_USES})
    """,
    "b7_reads_without_writer": f"""
        SELECT destination, n_readers FROM ({JOB_USE}) WHERE n_writers = 0
    """,
    "b7_contested_destinations": f"SELECT * FROM ({JOB_USE}) WHERE n_writers > 1",
    "b7_script_levels": f"""
        WITH RECURSIVE used AS (SELECT DISTINCT p_partkey AS s, destination AS d, role FROM ({JOB_USES})),
        waits AS (
          SELECT DISTINCT r.s AS a, w.s AS b FROM used r JOIN used w ON r.d = w.d
          WHERE r.role = 'read' AND w.role = 'write'
        ),
        reach AS (
          SELECT a, b FROM waits
          UNION
          SELECT reach.a, waits.b FROM reach JOIN waits ON reach.b = waits.a
        ),
        circle AS (
          SELECT x.a, min(x.b) AS cycle FROM reach x JOIN reach y ON x.b = y.a AND x.a = y.b GROUP BY x.a
        ),
        stuck AS (SELECT a FROM circle UNION SELECT reach.a FROM reach JOIN circle ON reach.b = circle.a),
        path AS (
          SELECT p_partkey AS a, p_partkey AS b, 0 AS n FROM part WHERE p_partkey NOT IN (SELECT a FROM stuck)
          UNION
          SELECT path.a, waits.b, n + 1 FROM path JOIN waits ON path.b = waits.a
        ),
        level AS (SELECT a, max(n) AS level FROM path GROUP BY a)
        SELECT p_partkey AS script, CAST(level AS BIGINT) AS level, cycle
        FROM part LEFT JOIN level ON p_partkey = level.a LEFT JOIN circle ON p_partkey = circle.a
    """,
    "g4_rewrite_calls": REWRITTEN_CALLS,
    # Every script begins with a comment line and calls the method.
    "g4_rewrite_defined": f"""
        SELECT p_partkey, regexp_replace(code, '^([^\n]*\n)', {text(DEFINED)}) AS code
        FROM ({REWRITTEN_CALLS})
    """,
    "h1_collisions": collisions(PART_PATHS),
    "h1_collisions_batches": collisions(ORDER_PATHS),
    "h1_collisions_orders": collisions(ORDER_PATHS),
    "b8_replace_published": "SELECT * FROM customer WHERE c_acctbal > 0",
    "h2_rows": f"""
        WITH line AS (
          SELECT l_orderkey, l_linenumber,
                 CASE l_orderkey % 3 WHEN 0 THEN 's3://lake/hot.csv' ELSE {LINE_PATH} END AS path
          FROM lineitem
        ),
        path AS (SELECT path, coalesce({target('path')}, path) AS destination FROM line GROUP BY path),
        meet AS (SELECT destination, count(*) AS n_paths FROM path GROUP BY destination)
        SELECT l_orderkey, l_linenumber, path, destination, n_paths
        FROM line JOIN path USING (path) JOIN meet USING (destination)
    """,
    "h2_plan": f"""
        SELECT DISTINCT path, {named(RULE_FIRST_DOT, 'path')} AS base,
               coalesce({target('path')}, path) AS destination,
               coalesce({target('path')}, path) <> path AS changed
        FROM {ORDER_PATHS}
    """,
    "h3_inventory": inventory("page_id", "html", "pages"),
    "h3_inventory_scripts": inventory("p_partkey", "code", SCRIPTS),
    "flow_priority_orders": """
        SELECT CAST(to_json({
                   'o_orderkey': o_orderkey, 'c_name': c_name,
                   'o_orderdate': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g'),
                   'o_totalprice': o_totalprice}) AS VARCHAR) AS record
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'
    """,
}
