import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryspark.sources import postings
from quarryspark.operators import bm25, citations, evaluate, fusion, prompts, vector
from tests.test_text import reference_tokens

CHUNK = "point_id bigint, file_path string, content string, symbol_name string, start_line int, end_line int, symbol_type string"
DOCS = [(1, "a.py", "read the cache and the index", "readCache", 1, 9, "function"), (2, "b.py", "write the index", None, 1, 5, None), (3, "c.md", "the the the story", None, 1, 3, None), (4, "d.md", "", None, 1, 1, None)]


def brute(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {d[0]: reference_tokens(" ".join([d[1], d[2], *([d[3]] * 3 if d[3] else [])])) for d in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for v in toks.values() for t in set(v))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: eps * mean if r < 0 else r for t, r in raw.items()}
    out = []
    for p, v in toks.items():
        c = Counter(v)
        s = round(sum(idf[q] * c[q] * (k1 + 1) / (c[q] + k1 * (1 - b + b * len(v) / avg)) for q in reference_tokens(query) if q in c), 6)
        if s > 0:
            out.append((p, s))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def test_bm25_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, CHUNK)
    texts = ["read cache", "index index write", "the story", "unknown", "", "..."]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")
    got = bm25.search(docs, q, 10).collect()
    for i, t in enumerate(texts):
        assert [(r.point_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == brute(DOCS, t)
    assert bm25.search(docs.limit(0), q, 10).count() == 0


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "point_id bigint, embedding array<double>")
    q = spark.createDataFrame([(7, [3.0, 0.0]), (8, None)], "query_id bigint, embedding array<double>")
    got = vector.search(v, q, 3).orderBy("rank").collect()
    assert [(r.query_id, r.point_id, r.score) for r in got] == [(7, 1, 1.0), (7, 6, 1.0), (7, 3, 0.70711)]
    assert vector.search(v, q.limit(0), 3).count() == 0


def test_many_queries_with_ties(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "SCORE_BYTES", 400_000)
    monkeypatch.setattr(vector, "QUERY_BYTES", 150_000)
    rng = np.random.default_rng(3)
    x, q = rng.integers(-2, 3, (700, 4)).astype(float), rng.integers(-2, 3, (5000, 4)).astype(float)
    v = spark.createDataFrame([(i * 7 % 701, r.tolist()) for i, r in enumerate(x)] + [(9001, [1.0, 2.0]), (9002, None)], "point_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id bigint, embedding array<double>")
    got = vector.search(v, asked, 6).toPandas().sort_values(["query_id", "rank"])
    ids = np.array([i * 7 % 701 for i in range(700)])
    live = np.linalg.norm(x, axis=1) > 0
    xn, keys = x[live] / np.linalg.norm(x[live], axis=1, keepdims=True), ids[live]
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    score = np.round(np.divide(q, norm, out=np.zeros_like(q), where=norm > 0) @ xn.T, 5)
    expected = keys[np.lexsort((np.broadcast_to(keys, score.shape), -score), axis=1)[:, :6]]
    assert got.point_id.to_numpy().reshape(5000, 6).tolist() == expected.tolist()


def test_stored_postings(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(DOCS, CHUNK)
    texts = ["read cache", "index index write", "the story", "unknown", "", "..."]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")
    for parts in (20_000_000, 1):
        monkeypatch.setattr(postings, "PART_ROWS", parts)
        index = postings.write_index(docs, str(tmp_path / f"i{parts}"))
        assert (index.stats["parts"] > 1) == (parts == 1)
        for named in (2000, 0):
            monkeypatch.setattr(bm25, "NAMED_TERMS", named)
            got = postings.open_index(spark, index.path).keyword(q, 10).collect()
            for i, t in enumerate(texts):
                assert [(r.point_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == brute(DOCS, t)
    assert [r.point_id for r in index.semantic(q.where("query_id = 2"), 1).collect()] == [3]
    empty = postings.write_index(docs.limit(0), str(tmp_path / "none"))
    assert empty.keyword(q, 10).count() == 0 and empty.semantic(q, 10).count() == 0
    assert postings.open_index(spark, str(tmp_path / "missing")) is None


def test_table_index_is_kept_until_the_table_changes(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, CHUNK)
    path = str(tmp_path / "chunks.parquet")
    docs.write.parquet(path)
    made = []

    def read():
        made.append(1)
        return spark.read.parquet(path)

    q = spark.createDataFrame([(1, "story")], "query_id bigint, query string")
    first = postings.table_index(spark, path, read)
    assert not made and first.keyword(q, 5).count() == first.keyword(q, 5).count() == 1 and len(made) == 1
    assert postings.table_index(spark, path, read) is first and first.semantic(q, 5).count() == first.semantic(q, 5).count() and len(made) == 2
    docs.limit(2).write.mode("append").parquet(path)
    assert postings.table_index(spark, path, read).path != first.path


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from quarryspark.errors import EngineError
    from quarryspark.sources.checkpoints import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(isLocal=lambda: False)))
    with pytest.raises(EngineError):
        shared_folder(SimpleNamespace(sparkContext=context, conf={}))


def test_embedding_is_normal(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "point_id bigint, content string")
    rows = vector.embed(df, "point_id", "content").collect()
    assert [r.point_id for r in rows] == [1] and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-9


def ranked(spark, pairs):
    return spark.createDataFrame([(0, i, p) for i, p in enumerate(pairs, 1)], "query_id bigint, rank int, point_id bigint")


def test_fusion(spark):
    got = fusion.fuse(ranked(spark, [1, 2, 3]), ranked(spark, [3, 4]), 10).orderBy("rank").collect()
    assert [r.point_id for r in got] == [3, 1, 2, 4]
    assert got[0].vector_rank == 3 and got[0].keyword_rank == 1 and got[1].keyword_rank is None
    assert fusion.fuse(ranked(spark, []), ranked(spark, [5]), 5).first().point_id == 5
    assert fusion.fuse(ranked(spark, [1, 2]), ranked(spark, [2, 1]), 1).first().point_id == 1


def test_rerank(spark):
    docs = spark.createDataFrame(DOCS, CHUNK)
    q = spark.createDataFrame([(0, "story")], "query_id bigint, query string")
    hits = ranked(spark, [1, 3]).withColumn("score", F.lit(0.5))
    got = fusion.rerank(hits, q, docs, 2).orderBy("rank").collect()
    assert [(r.point_id, r.rerank_score) for r in got] == [(3, 1.0), (1, 0.0)]


def test_citations(spark):
    a = spark.createDataFrame([(1, "o", "a.py:2-4 a.py:2-40 z.py:1-1 a.py:9-3 a.py:2-4"), (2, None, "a.py:1-2"), (3, "o", None)], "id bigint, owner string, answer string")
    h = spark.createDataFrame([("o", "a.py", 1, 5, 10, 2), ("o", "a.py", 2, 4, 11, 1)], "owner string, file_path string, start_line int, end_line int, point_id bigint, rank bigint")
    got = citations.verify(citations.extracted(a), h, ["owner"]).orderBy("id", "position").collect()
    assert [(r.id, r.status, r.point_id) for r in got] == [(1, "verified", 11), (1, "out_of_range", None), (1, "unknown_file", None), (1, "out_of_range", None), (2, "unknown_file", None)]
    assert citations.unverified(citations.verify(citations.extracted(a), h, ["owner"])).where("id = 1").first().unverified == 3


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a"), (2, 1, "b")], "query_id bigint, rank int, file_path string")
    q = spark.createDataFrame([(1, "c", ["a", "q"]), (2, "c", ["b"]), (3, "d", ["z"])], "query_id bigint, category string, expected_files array<string>")
    correct = evaluate.first_correct(evaluate.ranked_files(hits), q)
    m = evaluate.ranking_metrics(correct).first()
    assert (m.questions, m.recall_at_1, m.recall_at_3, m.mrr) == (3, 0.333333, 0.666667, 0.5)
    assert {r.query_id: r.files for r in evaluate.misses(correct, evaluate.ranked_files(hits)).collect()} == {1: ["x", "a"], 3: None}


def test_prompts(spark):
    q = spark.createDataFrame([(0, "why"), (1, "how")], "query_id bigint, query string")
    h = spark.createDataFrame([(0, 2, "b.py", 1, 2, None, "f", "B"), (0, 1, "a.py", 3, 4, "class", "C", "A")], "query_id bigint, rank int, file_path string, start_line int, end_line int, symbol_type string, symbol_name string, content string")
    got = {r.query_id: r.prompt for r in prompts.prompts(q, h).collect()}
    assert got[0].index("Excerpt 1: a.py:3-4 (class C)") < got[0].index("Excerpt 2: b.py:1-2 (symbol f)") and got[0].endswith("Question: why")
    assert "(no excerpts found)" in got[1]


def test_metrics_over_every_question(spark):
    from quarryspark.plans import queries as Q

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/eval_items.parquet").count()
    assert {r.questions for r in Q.QUERIES["retrieval_metrics_all"](spark, d).collect()} == {n}
    some = {r.variant: r for r in Q.QUERIES["retrieval_metrics"](spark, d).collect()}
    assert all(0 < r.questions < n for r in some.values())
