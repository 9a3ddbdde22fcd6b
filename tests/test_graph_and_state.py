import datetime
import subprocess

import pytest

from quarryspark.config import LIMITS
from quarryspark.errors import EngineError
from quarryspark.operators import graph, incremental, replay
from quarryspark.plans.engine import Engine
from quarryspark.sources.repository import confined
from quarryspark.streaming import ingest

FILES = "owner string, name string, path string, content string"


def test_difference(spark):
    old = spark.createDataFrame([("o", "n", "a", "1"), ("o", "n", "b", "2"), ("o", "n", "c", "3")], FILES)
    new = spark.createDataFrame([("o", "n", "a", "1"), ("o", "n", "b", "9"), ("o", "n", "d", "4"), ("o", "n", "e", None)], FILES)
    diff = incremental.difference(incremental.snapshot(old), incremental.snapshot(new))
    assert {r.path: r.change for r in diff.collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}
    assert sorted(r.path for r in incremental.to_index(diff, new).collect()) == ["b", "d"]
    assert incremental.difference(incremental.snapshot(old.limit(0)), incremental.snapshot(new)).where("change = 'added'").count() == 3


def test_import_graph(spark):
    rows = [
        ("src/pkg/__init__.py", ""), ("src/pkg/a.py", "from pkg.b import x\nfrom . import c\nimport os\nfrom .. import nothing"), ("src/pkg/b.py", "from ...... import far"), ("src/pkg/c.py", "def ("),
        ("b.py", ""), ("web/index.ts", "import x from './util'; import('./lib')"), ("web/util.tsx", ""), ("web/lib/index.js", "export * from '../util'"), ("web/lib/self.js", "from './self'"),
    ]
    df = spark.createDataFrame([("o", "n", p, c) for p, c in rows], FILES)
    edges = {(r.source, r.target) for r in graph.dependency_edges(df).collect()}
    assert edges == {("src/pkg/a.py", "src/pkg/b.py"), ("src/pkg/a.py", "src/pkg/__init__.py"), ("web/index.ts", "web/util.tsx"), ("web/index.ts", "web/lib/index.js"), ("web/lib/index.js", "web/util.tsx")}
    index = {r.key: r.path for r in graph.suffix_index(df).collect()}
    assert index["b"] == "b.py" and index["pkg/b"] == "src/pkg/b.py" and index["pkg"] == "src/pkg/__init__.py"


def test_limiter():
    r = replay.RateLimiter(2, 60)
    assert [r.allow(t) for t in (0, 1, 2, 60, 61, 61.5)] == [True, True, False, True, True, False]
    with pytest.raises(EngineError) as e:
        r.check(62)
    assert e.value.status == 429


def test_cache():
    c = replay.AnswerCache(2)
    c.put(("o", "n", "1"), "a")
    c.put(("o", "n", "2"), "b")
    assert c.get(("o", "n", "1")) == "a"
    c.put(("o", "m", "3"), "c")
    assert c.get(("o", "n", "2")) is None
    c.invalidate("o", "n")
    assert list(c.kept) == [("o", "m", "3")]


def test_replay_equals_a_loop(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(seconds=(i * 7919) % 4000), i % 3) for i in range(300)] + [(900, None, 1), (901, base, None)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint")
    got = {r.event_id: r.allowed for r in replay.rate_limit(events, "user_id", 5, 600).collect()}
    limiters = {}
    for i, ts, u in sorted(rows, key=lambda r: (r[1] is not None, r[1] or base, r[0])):
        assert got[i] == limiters.setdefault(u, replay.RateLimiter(5, 600)).allow(ts.timestamp() if ts else 0.0)
    n = {r.event_id: r.n for r in replay.trailing_calls(events.where("ts IS NOT NULL"), "user_id", 600).collect()}
    for i, ts, u in rows:
        if ts:
            assert n[i] == sum(v == u and t is not None and 0 <= (ts - t).total_seconds() < 600 for _, t, v in rows)


def test_confined():
    assert confined("a/./b/../c.py") == "a/c.py"
    for bad in ("../x", "a/../../x", "/etc/passwd"):
        with pytest.raises(EngineError):
            confined(bad)


MINI = {"app/auth.py": "def create_token(user):\n    return user\n\n\ndef check(token):\n    return token == 1\n", "tests/test_auth.py": "from app.auth import create_token\n\n\ndef test_token():\n    assert create_token(1)\n", "README.md": "# Demo\n\nThis project signs tokens.\n"}


def test_engine_end_to_end(spark, tmp_path):
    files = spark.createDataFrame(list(MINI.items()), "path string, content string")
    e = Engine(spark, tmp_path / "index")
    with pytest.raises(EngineError) as missing:
        e.search("o", "n", "token")
    assert missing.value.status == 404
    e.add_repository("o", "n", files, "c1")
    job = e.index("o", "n")
    assert (job.state, job.error) == ("ready", None) and e.store.count("o", "n") == job.chunks
    hits = e.search("o", "n", "create_token", "hybrid", 3)
    assert hits[0].file_path in ("app/auth.py", "tests/test_auth.py")
    assert e.search("o", "n", "...", "keyword") == []
    assert [h.file_path for h in e.search("o", "n", "signs tokens project", "keyword", 1)] == ["README.md"]
    assert len(e.search("o", "n", "token", "hybrid", 2, True)) == 2
    answer = e.ask("o", "n", "create_token", now=0.0)
    assert answer["unverified"] == 0 and answer["citations"] and e.ask("o", "n", "create_token", now=0.0) is answer
    found = e.investigate("o", "n", "create_token", lambda q, s: [("search_symbol", "check"), ("read_tests", "token"), ("read_file", "app/auth.py:1-2"), None][len(s)], now=1.0)
    assert [s.tool for s in found["steps"]] == ["search_symbol", "read_tests", "read_file"] and found["hits"]
    nodes, edges = e.dependencies("o", "n")
    assert nodes.count() == 3 and [(r.source, r.target) for r in edges.collect()] == [("tests/test_auth.py", "app/auth.py")]
    assert e.reindex("o", "n")["unchanged"] == 3
    changed = dict(MINI, **{"README.md": "# Demo\n\nNothing about it.\n", "new.py": "def fresh():\n    return 1\n"})
    del changed["tests/test_auth.py"]
    e.add_repository("o", "n", spark.createDataFrame(list(changed.items()), "path string, content string"), "c2")
    r = e.reindex("o", "n")
    assert (r["added"], r["modified"], r["deleted"], r["unchanged"]) == (1, 1, 1, 1)
    assert {x.file_path for x in e.store.chunks("o", "n").select("file_path").collect()} == {"README.md", "app/auth.py", "new.py"}
    e.store.delete_file("o", "n", "new.py")
    assert e.store.chunks("o", "n").where("file_path = 'new.py'").count() == 0
    summary = e.files("o", "n")
    assert summary["totals"].first().selected == 3 and not summary["truncated"]
    assert e.chunks("o", "n")["totals"].first().chunks >= 4
    with pytest.raises(EngineError):
        e.search("o", "n", "x", "other")


def test_checkout(spark, tmp_path):
    repo = tmp_path / "r"
    for p, c in MINI.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(c)
    (repo / "ignored.py").write_text("x = 1\n")
    (repo / "bin.py").write_bytes(b"\xff\xfe\0")
    (repo / ".gitignore").write_text("ignored.py\n")
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(repo), *args], check=True)
    e = Engine(spark, tmp_path / "index")
    commit = e.add_repository("o", "n", repo)
    assert len(commit) == 40
    rows = {r.path: r.skip_reason for r in e.scanned("o", "n").collect()}
    assert "ignored.py" not in rows and rows["bin.py"] == "binary_veya_bozuk" and rows["app/auth.py"] is None


def test_clone(spark, tmp_path):
    from quarryspark.functions import addresses
    from quarryspark.sources.repository import clone, head_commit, tracked_files

    origin = tmp_path / "origin"
    origin.mkdir()
    (origin / "a.py").write_text("x = 1\n")
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(origin), *args], check=True)
    there = clone(f"file://{origin}", tmp_path / "roots", "o", "n")
    assert tracked_files(there) == ["a.py"] and head_commit(there) == head_commit(origin) and clone("file:///gone", tmp_path / "roots", "o", "n") == there
    with pytest.raises(EngineError) as e:
        clone(f"file://{tmp_path}/gone", tmp_path / "roots", "o", "other")
    assert e.value.status in (404, 502) and not (tmp_path / "roots" / "o" / "other").exists() and len(list((tmp_path / "roots" / "o").iterdir())) == 1
    with pytest.raises(EngineError):
        clone("x", tmp_path, "..", "n")
    messages = ["fatal: Could not resolve host: x", "Authentication failed", "ERROR: Repository not found.", "disk full"]
    from pyspark.sql import functions as F

    m = spark.createDataFrame([(x,) for x in messages], "m string")
    rows = m.select(addresses.clone_failure_message(F.col("m")), addresses.clone_failure_status(F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [addresses.clone_failure(x) for x in messages]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("o", "n", p, c) for p, c in MINI.items()], FILES).write.parquet(src)
    q = ingest.write_chunks(ingest.chunk_stream(ingest.stream_files(spark, src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    # two functions; an import and a function; one window
    assert {r.file_path: r["count"] for r in out.groupBy("file_path").count().collect()} == {"app/auth.py": 2, "tests/test_auth.py": 2, "README.md": 1}
    calls = str(tmp_path / "calls")
    spark.createDataFrame([("u", float(t)) for t in range(15)], "key string, second double").write.parquet(calls)
    s = ingest.limit_stream(ingest.stream_files(spark, calls)).writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    s.awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM limited WHERE allowed").first().n == LIMITS.rate_calls


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 0, s), 1) for s in range(5)], "ts timestamp, user_id bigint").write.parquet(src)
    s = ingest.windowed_counts(ingest.stream_files(spark, src)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination()
    assert spark.sql("SELECT n FROM counts").first().n == 5
