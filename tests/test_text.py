import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryspark.config import REFUSAL_MARKERS
from quarryspark.functions import addresses, text


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def reference_tokens(value):
    out = []
    for raw in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+", value):
        out.append(raw.lower())
        for part in re.split(r"_|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", raw):
            if part and part.lower() != raw.lower():
                out.append(part.lower())
    return out


def test_tokens(spark):
    values = ["JwtService parseHTTPUrl create_token", "_x __init__ a1B2", "", "...", "12ab çok été", "ABCDef getX"]
    assert one(spark, values, text.code_tokens) == [reference_tokens(v) for v in values]
    assert one(spark, [None], text.code_tokens) == [None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aAbBzZ09_ .é", max_size=25), min_size=1, max_size=40))
def test_tokens_property(spark, values):
    assert one(spark, values, text.code_tokens) == [reference_tokens(v) for v in values]
    assert [sorted(v) for v in one(spark, values, text.code_token_bag)] == [sorted(reference_tokens(v)) for v in values]


def test_lines(spark):
    values = ["", "a", "a\n", "a\nb", "\n", "a\r\nb\r\n"]
    assert one(spark, values, text.count_lines) == [0, 1, 1, 2, 1, 2]
    assert one(spark, values, text.line_array) == [[], ["a"], ["a"], ["a", "b"], [""], ["a", "b"]]


def test_extension(spark):
    assert one(spark, ["a/b.PY", ".py", "a.b/c", "x.tar.gz", "a/.env.ts"], text.file_extension) == [".py", "", "", ".gz", ".ts"]


def test_citations(spark):
    got = one(spark, ["see a/b.py:1-2 and a/b.py:1-2, .github/x.yml:3-4 c.ts:9", "", None], text.citations)
    assert [(c.file_path, c.start_line, c.end_line) for c in got[0]] == [("a/b.py", 1, 2), ("github/x.yml", 3, 4)]
    assert got[1] == [] and got[2] is None


def test_preview_and_refusal(spark):
    assert one(spark, ["x" * 201, "x" * 200], text.preview) == ["x" * 200 + "...", "x" * 200]
    assert one(spark, ["I Could Not Find it", "fine", None], lambda c: text.is_refusal(c, REFUSAL_MARKERS)) == [True, False, False]


def test_addresses(spark):
    good = ["https://github.com/a/b", " http://www.github.com/a/b.git ", "github.com/a-b/c.d/", "www.github.com/a/b", "github.com/A/_"]
    bad = ["https://example.com/a/b", "github.com/a", "github.com/-a/b", "github.com/a/..", ""]
    assert all(r is not None for r in one(spark, good, addresses.parse_address))
    assert one(spark, bad, addresses.parse_address) == [None] * 5
    assert one(spark, ["Could not resolve host", "authentication FAILED", "not found", "x"], addresses.clone_failure_status) == [502, 403, 404, 502]
