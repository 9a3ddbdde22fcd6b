import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryspark.errors import EngineError
from quarryspark.functions import addresses
from quarryspark.operators import model, prompts
from quarryspark.plans import reports
from quarryspark.plans.engine import NO_EVIDENCE, WRAP_UP, Engine
from quarryspark.schemas import HIT_FIELDS
from quarryspark.sources import evaluation

MINI = {"app/auth.py": "def create_token(user):\n    return user\n\n\ndef check(token):\n    return token == 1\n", "tests/test_auth.py": "from app.auth import create_token\n\n\ndef test_token():\n    assert create_token(1)\n", "README.md": "# Demo\n\nThis project signs tokens.\n"}


def engine(spark, root, **options):
    e = Engine(spark, root, **options)
    e.add_repository("o", "n", spark.createDataFrame(list(MINI.items()), "path string, content string"), "c1")
    return e


def test_background_job(spark, tmp_path):
    def slow(rows, key, text):
        time.sleep(1.5)
        return rows.select(key, F.array(F.lit(1.0), F.length(text).cast("double")).alias("embedding"))

    e = engine(spark, tmp_path / "i", embed=slow)
    with pytest.raises(EngineError):
        e.start_index("o", "other")
    job = e.start_index("o", "n")
    assert e.start_index("o", "n") is job and e.index_status("o", "n") is job and job.state != "ready"
    seen = set()
    while job.state not in ("ready", "failed"):
        seen.add(job.state)
        time.sleep(0.02)
    assert job.state == "ready" and {"parsing", "embedding"} <= seen | {s for s, _ in job.history} and [s for s, _ in job.history] == ["queued", "parsing", "embedding", "ready"]
    assert e.store.count("o", "n") == job.chunks > 0
    broken = engine(spark, tmp_path / "j", embed=lambda *a: 1 / 0)
    assert (lambda j: (j.state, "zero" in j.error))(broken.index("o", "n")) == ("failed", True)
    short = engine(spark, tmp_path / "k", embed=lambda rows, key, text: rows.select(key, F.array(F.lit(1.0)).alias("embedding")))
    short.index("o", "n")
    chunks = short.store.chunks("o", "n")
    with pytest.raises(EngineError):
        short.store.write("o", "n", chunks, short.store.state("o", "n"), "c", chunks.select("point_id", "embedding").limit(1))
    before = short.store.version("o", "n")
    short.store.delete_file("o", "n", "README.md")
    short.store.prune("o", "n", [])
    assert short.store.version("o", "n") != before and short.store.search_index("o", "n").stats["n"] == short.store.count("o", "n")
    short.store.reset("o", "n")
    assert not short.store.exists("o", "n") and short.store.count("o", "n") == 0


def test_answer_chain(spark, tmp_path):
    asked = []

    def say(name, result):
        def answer(question, prompt, hits):
            asked.append((name, prompt))
            if isinstance(result, Exception):
                raise result
            return result

        return answer

    e = engine(spark, tmp_path / "i")
    e.index("o", "n")
    e.answerers = [say("a", RuntimeError("503 busy")), say("b", " "), say("c", "It is here (app/auth.py:1-2).")]
    got = e.ask("o", "n", "create_token", now=0.0)
    assert got["answer"] == "It is here (app/auth.py:1-2)." and [n for n, _ in asked] == ["a", "b", "c"]
    for chain, status in (([RuntimeError("429"), RuntimeError("UNAVAILABLE")], 503), ([RuntimeError("429"), ""], 502), ([RuntimeError("401 PERMISSION")], 502), ([RuntimeError("boom")], 502)):
        e.answerers = [say("x", r) for r in chain]
        with pytest.raises(EngineError) as err:
            e.ask("o", "n", f"create_token {status} {len(chain)} {chain[0]}", now=100.0 * len(asked))
        assert err.value.status == status
    e.answerers = [say("w", "Seen (app/auth.py:1-2).")]
    found = e.investigate("o", "n", "create_token", lambda q, s: ("search_symbol", "create_token"), now=10_000.0)
    assert found["wrapped_up"] and len(found["steps"]) == 12 and asked[-1][1].endswith(WRAP_UP)
    found = e.investigate("o", "n", "create_token", now=20_000.0)
    assert not found["wrapped_up"] and WRAP_UP not in asked[-1][1]
    hits = Engine.serialised(e.search("o", "n", "create_token", "keyword", 2))
    assert all(list(h) == HIT_FIELDS for h in hits) and hits[0]["rerank_score"] is None


def test_failures(spark):
    for text, status in (("429 x", 429), ("UNAVAILABLE", 503), ("404", 502), ("403", 502), ("", 502)):
        assert addresses.failure(text)[1] == status
    m = spark.createDataFrame([("429 x",), ("UNAVAILABLE",), ("404",), ("403",), ("",)], "m string")
    assert [r[0] for r in m.select(addresses.service_failure_message(F.col("m"))).collect()] == [addresses.failure(t)[0] for t in ("429 x", "UNAVAILABLE", "404", "403", "")]


def test_evaluation_runs(spark, tmp_path):
    path = str(tmp_path / "questions.json")
    questions = [{"id": "a", "category": "auth", "question": "create_token user", "expected_files": ["app/auth.py"]}, {"id": "b", "category": "docs", "question": "signs tokens project", "expected_files": ["README.md"]}, {"id": "c", "category": "docs", "question": "zzz qqq", "expected_files": ["x.py"]}]
    (tmp_path / "questions.json").write_text(json.dumps({"repository": {"owner": "o", "name": "n"}, "questions": questions}))
    repository, rows = evaluation.load_questions(spark, path)
    assert repository["owner"] == "o" and [(r.query_id, r.id, r.expected_files) for r in rows.orderBy("query_id").collect()] == [(i, q["id"], q["expected_files"]) for i, q in enumerate(questions)]
    for bad in ("missing.json", "bad.json"):
        (tmp_path / "bad.json").write_text("[]")
        with pytest.raises(EngineError):
            evaluation.load_questions(spark, str(tmp_path / bad))
    e = engine(spark, tmp_path / "i")
    e.index("o", "n")
    e.warm_up("o", "n", "token")
    result = e.compare("o", "n", rows)
    assert {r.variant for r in result["overall"]} == set(Engine.VARIANTS) and {r.category for r in result["by_category"]} == {"auth", "docs"}
    keyword = next(r for r in result["overall"] if r.variant == "keyword")
    assert keyword.questions == 3 and keyword.recall_at_3 == round(2 / 3, 6)
    text = reports.ranking_report(result)
    assert "best MRR: " + result["best"] in text and "2: not found" in text
    answers = e.hallucination_run("o", "n", rows)
    assert [a["id"] for a in answers] == ["a", "b", "c"] and not answers[0]["refused"] and "app/auth.py" in answers[0]["answer"]
    e.answerers = [lambda q, p, h: NO_EVIDENCE]
    assert all(a["refused"] for a in e.hallucination_run("o", "n", rows))
    report = reports.refusal_report(answers)
    assert report.startswith("3 questions") and "auth" in report
    evaluation.save_results(spark, str(tmp_path / "out.json"), rows=answers, overall=result["overall"])
    saved = json.loads((tmp_path / "out.json").read_text())
    assert saved["rows"] == answers and saved["overall"][0]["questions"] == 3
    with pytest.raises(EngineError):
        e.evaluate("o", "n", rows, "other")


def test_formatted_hits(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id bigint, query string")
    hits = spark.createDataFrame([(1, 2, "b.py", 3, 4, None, None, "y"), (1, 1, "a.py", 1, 2, "function", "f", "x")], "query_id bigint, rank int, file_path string, start_line int, end_line int, symbol_type string, symbol_name string, content string")
    assert {r.query_id: r.text for r in prompts.formatted(q, hits).collect()} == {1: "--- a.py:1-2 (function f) ---\nx\n\n--- b.py:3-4 ---\ny", 2: "No results."}


def test_model_plugins(spark, tmp_path):
    def load():
        return lambda texts: np.array([[t.count("a"), t.count("b"), 0.0] for t in texts])

    embed = model.embedder(load, "letters", batch=2)
    rows = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, ""), (4, None), (5, "c")], "k bigint, t string")
    got = {r.k: r.embedding for r in embed(rows, "k", "t").collect()}
    assert set(got) == {1, 2, 5} and got[1] == [1.0, 0.0, 0.0] and got[5] == [0.0, 0.0, 0.0]
    score = model.scorer(lambda: lambda pairs: np.array([len(set(q) & set(d)) for q, d in pairs]), "overlap")
    e = engine(spark, tmp_path / "i", embed=embed, scorer=score)
    assert e.index("o", "n").state == "ready"
    assert len(e.search("o", "n", "ab", "semantic", 2)) == 2 and e.search("o", "n", "create_token", "hybrid", 2, True)[0].rerank_score > 0
