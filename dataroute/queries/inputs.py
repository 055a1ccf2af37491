"""Columns that the queries derive from the tables, in SQL both engines read."""

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Paths with dots in the name, with one, two or no extensions. Many share a name.
PART_PATH = """
    's3://lake/' || lower(replace(p_brand, '#', '')) || '/p' || p_size
    || '.v' || (p_partkey % 3)
    || CASE p_partkey % 4
         WHEN 0 THEN '.csv' WHEN 1 THEN '.parquet' WHEN 2 THEN '' ELSE '.tar.gz'
       END
"""

# Paths with leading dots, special names, folders and no extension. A few
# destinations are shared by a large part of all rows.
ORDER_PATH = """
    CASE o_orderkey % 3 WHEN 0 THEN 's3://lake/' WHEN 1 THEN '/data.v2/' ELSE '' END
    || lower(o_orderstatus) || '/c' || o_custkey
    || CASE o_orderkey % 7
         WHEN 0 THEN '/.config' WHEN 1 THEN '/data.v1.csv'
         WHEN 2 THEN '/F8.TBLR.data' WHEN 3 THEN '/' WHEN 4 THEN '/README'
         WHEN 5 THEN '/..' ELSE '.orders.json'
       END
"""

# The same with newlines: in front, behind, in a folder's name and in the file's.
ORDER_PATH_LINES = f"""
    CASE o_orderkey % 5
      WHEN 0 THEN 'x.y' || chr(10) || {ORDER_PATH}
      WHEN 1 THEN {ORDER_PATH} || chr(10) || 'tail'
      WHEN 2 THEN 'a.b/c' || chr(10) || 'd.e/' || chr(10) || {ORDER_PATH}
      WHEN 3 THEN {ORDER_PATH} || chr(10)
      ELSE 'a' || chr(10) || 'b.c' || chr(10) || {ORDER_PATH} || chr(10) || '.z'
    END
"""

# Paths of lines: many share a name, few a path.
LINE_PATH = """
    's3://lake/' || lower(l_returnflag) || '/' || l_suppkey || '/p' || l_partkey
    || CASE l_linenumber % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.v2.parquet' ELSE '' END
"""

# Scripts with calls that count and with calls that do not: in a comment, in a
# string, with a keyword, with a variable, of another method.
PART_SCRIPT = f"""
    '# loads ' || p_name || ', not .parquet("/skipped/comment.parquet")' || chr(10)
    || 'df = spark.read.parquet("' || {PART_PATH} || '")' || chr(10)
    || 'df.write.mode(' || chr(39) || 'append' || chr(39) || ').parquet( '
    || chr(39) || '/out/' || lower(p_type) || '.parquet' || chr(39)
    || ', compression="zstd")' || chr(10)
    || 'print("use .parquet(' || chr(39) || '/skipped/string.parquet' || chr(39)
    || ') here")' || chr(10)
    || 'df.write.parquet(path="/skipped/keyword.parquet")' || chr(10)
    || 'target = "/out/' || p_partkey || '.parquet"' || chr(10)
    || 'df.write.parquet(target)' || chr(10)
    || 'df.write.csv("/out/p' || p_size || '.csv")  # kept' || chr(10)
"""

# Scripts that read and write each other's tables, with what only a scanner tells apart:
# quotes inside f-strings, brackets around a literal, a call in a replacement field. Each
# writes a table and reads that of another one (a third of its number), one of a few raw
# files, and the calendar, which a third of all scripts read. Every fortieth adds to one
# shared table, which a few read; every 97th reads what depends on it.
PART_JOB = """
    'rate = f"{conf["rate"]:>{conf["width"]}}" + f"{"}"}"' || chr(10)
    || 'a = spark.read.parquet(("/stage/t' || CAST(floor(p_partkey / 3) AS BIGINT) || '.parquet"))' || chr(10)
    || 'b = spark.read.csv(' || chr(92) || chr(10) || '    "/raw/' || lower(p_brand) || '.csv")' || chr(10)
    || CASE p_partkey % 3 WHEN 0
         THEN 'log(f"{spark.read.json("/ref/calendar.v1.json").count():,}")' || chr(10) ELSE '' END
    || CASE p_partkey % 250 WHEN 249
         THEN 'c = spark.read.parquet(("/mart/shared.parquet"), f"{a["x"]}")' || chr(10) ELSE '' END
    || CASE p_partkey % 97 WHEN 0
         THEN 'd = spark.read.parquet("/stage/t' || (3 * p_partkey) || '.parquet")' || chr(10) ELSE '' END
    || 'a.join(b, f"{"k"}").write.mode(f"{"over"}write").parquet("/stage/t' || p_partkey || '.parquet")' || chr(10)
    || CASE p_partkey % 40 WHEN 0
         THEN 'a.write.mode("append").parquet((("/mart/shared.parquet")))  # "' || chr(10) ELSE '' END
    || CASE p_partkey WHEN 1 THEN 'b.write.json("/ref/calendar.v1.json")' || chr(10) ELSE '' END
    || 'a.write.parquet(("/skipped/" + name)); a.write.parquet(("/skipped/x", 1))' || chr(10)
    || '# a.write.parquet("/skipped/comment.parquet")' || chr(10)
"""
