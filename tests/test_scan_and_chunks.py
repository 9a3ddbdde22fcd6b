import pytest
from pyspark.sql import functions as F

from quarryspark.config import Limits
from quarryspark.operators import line_chunks, scan, symbol_chunks

FILE = "path string, size bigint, content string"


def test_first_rule_wins(spark):
    key = "AKIA" + "A" * 16
    rows = [("node_modules/a.py", None, None), ("dist.py", 1, "x"), ("src/dist/a.py", 1, "x"), ("a.jsx", 1, "x"), ("a.py", None, "x"), ("a.py", 1_000_001, "x"), ("a.py", 1_000_000, "x"), ("a.md", 1, None), ("a.md", 1, "a\0b"), ("a.ts", 1, f"k={key}"), ("a.PY", 1, "")]
    got = spark.createDataFrame(rows, FILE).select(scan.skip_reason(F.col("path"), F.col("size"), F.col("content")).alias("r")).collect()
    assert [r.r for r in got] == ["uretilmis_klasor", None, "uretilmis_klasor", "desteklenmeyen_uzanti", "okunamadi", "cok_buyuk", None, "binary_veya_bozuk", "binary_veya_bozuk", "sir_iceriyor", None]


def test_secrets(spark):
    yes = ["-----BEGIN RSA PRIVATE KEY-----", "AKIA" + "0" * 16, "AIza" + "b" * 35, "ghp_" + "c" * 36, "xoxb-" + "1" * 10]
    no = ["-----BEGIN PUBLIC KEY-----", "AKIA" + "0" * 15, "token = abc", "ghx_" + "c" * 36, "xoxb-1"]
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    assert [r.s for r in df.select(scan.contains_secret(F.col("v")).alias("s")).collect()] == [True] * 5 + [False] * 5


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\0b"),), (bytearray(b"\xff\xfe"),), (None,)], "b binary")
    assert [r.t for r in df.select(scan.decode_text(F.col("b")).alias("t")).collect()] == ["ok", None, None, None]


def test_selection_of_empty_tables(spark):
    scanned = spark.createDataFrame([], "file_id bigint, owner string, name string, path string, size_bytes bigint, lines int")
    texts = spark.createDataFrame([], "file_id bigint, content string")
    assert scan.selection(scanned, texts).count() == 0
    assert scan.totals(scan.selection(scanned, texts)).first().total_tracked == 0


def windows_of(spark, content, **kw):
    df = spark.createDataFrame([("a.py", content)], "file_path string, content string")
    return [(r.start_line, r.end_line, r.content) for r in line_chunks.line_windows(df, **kw).orderBy("start_line").collect()]


def test_line_windows(spark):
    lines = [f"line {i}" for i in range(1, 301)]
    got = windows_of(spark, "\n".join(lines))
    assert [(a, b) for a, b, _ in got] == [(1, 120), (101, 220), (201, 300)]
    assert got[1][2] == "\n".join(lines[100:220])
    assert windows_of(spark, "") == [] and windows_of(spark, "\n \n") == [] and windows_of(spark, None) == []
    assert len(windows_of(spark, "x\n" * 120)) == 1 and len(windows_of(spark, "x\n" * 121)) == 2
    with pytest.raises(ValueError):
        windows_of(spark, "x", size=5, overlap=5)


MODULE = '''import os
X = 1


@deco
def first(a):
    return a


class Second:
    def method(self):
        return 2

y = 3
'''


def test_python_symbols():
    got = [(a, b, k, n) for a, b, _, k, n in symbol_chunks.pieces(".py", MODULE)]
    assert got == [(1, 2, "module", None), (5, 7, "function", "first"), (10, 12, "class", "Second"), (14, 14, "module", None)]


def test_broken_python_falls_back():
    assert [(a, b, k) for a, b, _, k, _ in symbol_chunks.pieces(".py", "def (:\n  x\n")] == [(1, 2, None)]


def test_long_class_is_cut_at_methods():
    body = "class Big:\n    a = 1\n" + "".join(f"    def m{i}(self):\n" + "        x = 1\n" * 60 + "\n" for i in range(4)) + "    tail = 2\n"
    got = symbol_chunks.pieces(".py", body)
    assert [n for *_, k, n in got if k == "function"] == ["m0", "m1", "m2", "m3"]
    covered = sorted(i for a, b, *_ in got for i in range(a, b + 1))
    lines = body.split("\n")
    assert all(i in covered for i, ln in enumerate(lines, 1) if ln.strip())
    assert all(b - a + 1 <= 150 for a, b, *_ in got)


SCRIPT = '''import { a } from "./a";

/** A note about {braces}. */
export function run(x) {
  const r = /^[a-z({]+$/.test(x);
  return `t ${x} {`;
}

export class Box {
  open() {
    return 1;
  }
}

const f = () => 3;
export type Kind =
  | "a"
  | "b";
interface Shape { x: number }
'''


def test_script_symbols():
    got = [(k, n) for _, _, _, k, n in symbol_chunks.pieces(".ts", SCRIPT)]
    assert ("function", "run") in got and ("class", "Box") in got and ("type", "Kind") in got and ("interface", "Shape") in got
    assert ("module", None) in got


JAVA = '''package a.b;

import java.util.List;

@Deprecated
public final class Box<T> {
    private int x = 1;

    public Box() { x = 2; }

    static int open(List<T> l) throws Exception {
        return '{' + 1;
    }
}

enum Kind { A, B }
'''


def test_java_symbols():
    got = [(a, b, k, n) for a, b, _, k, n in symbol_chunks.pieces(".java", JAVA)]
    assert (5, 14, "class", "Box") in got and (16, 16, "enum", "Kind") in got
    small = [(k, n) for _, _, _, k, n in symbol_chunks.pieces(".java", JAVA, Limits(max_symbol_lines=4, window_lines=4, window_overlap=0))]
    assert ("constructor", "Box") in small and ("method", "open") in small


def test_symbol_chunks_in_spark(spark):
    df = spark.createDataFrame([("o", "n", "a.py", MODULE), ("o", "n", "b.md", "# t\n"), ("o", "n", "c.py", None), ("o", "n", "d.py", "")], "owner string, name string, path string, content string")
    got = symbol_chunks.symbol_chunks(df)
    assert got.where("file_path = 'a.py'").count() == 4 and got.where("file_path = 'b.md'").count() == 1 and got.count() == 5
    assert got.where("chunk_id = 'a.py:5-7'").first().symbol_name == "first"
