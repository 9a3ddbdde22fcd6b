from pyspark.sql import functions as F

from quarryspark.functions import text
from quarryspark.operators import line_chunks, scan, symbol_chunks
from quarryspark.plans import sql

ROWS = [("a/B.PY", "def f():\n    return 1\n\n\nclass ReadCache:\n    x = 'y'\n"), ("c.md", "line\r\n" * 300), ("d.ts", ""), ("e", None), (".hidden", "getHTTPResponse my_name 12"), ("k.py", "key = '" + "AKIA" + "ABCDEFGHIJKLMNOP" + "'")]


def test_sql_functions(spark):
    sql.register(spark)
    df = spark.createDataFrame([(i, "o", "n", p, t) for i, (p, t) in enumerate(ROWS)], "file_id bigint, owner string, name string, path string, content string")
    df.createOrReplaceTempView("qs_files")
    got = spark.sql("SELECT file_id, qs_lines(content) l, qs_line_count(content) n, qs_preview(content) p, qs_extension(path) e, qs_has_secret(content) s, qs_tokens(content) t FROM qs_files ORDER BY file_id").collect()
    c = F.col("content")
    expected = df.select("file_id", text.line_array(c).alias("l"), text.count_lines(c).alias("n"), text.preview(c).alias("p"), text.file_extension(F.col("path")).alias("e"), scan.contains_secret(c).alias("s"), text.code_tokens(c).alias("t")).orderBy("file_id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in expected]


def test_sql_chunks(spark):
    sql.register(spark)
    df = spark.createDataFrame([(i, "o", "n", p, t) for i, (p, t) in enumerate(ROWS)], "file_id bigint, owner string, name string, path string, content string")
    df.createOrReplaceTempView("qs_files")
    got = spark.sql("SELECT f.path, c.start_line, c.end_line, c.content FROM qs_files f, LATERAL qs_line_windows(f.content) c").collect()
    expected = line_chunks.line_windows(df.withColumnRenamed("path", "file_path").select("file_id", "file_path", "content")).collect()
    assert sorted((r.start_line, r.end_line, r.content) for r in got) == sorted((r.start_line, r.end_line, r.content) for r in expected)
    got = spark.sql("SELECT f.path, c.* FROM qs_files f, LATERAL qs_symbol_chunks(f.path, f.content) c").collect()
    expected = symbol_chunks.symbol_chunks(df).collect()
    assert sorted((r.path, r.start_line, r.end_line, r.content, str(r.symbol_name)) for r in got) == sorted((r.file_path, r.start_line, r.end_line, r.content, str(r.symbol_name)) for r in expected)
