import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryspark.llm import packing as P
from quarryspark.llm import splitting as S


def check(text):
    pieces = S.split(text)
    assert pieces[0][:2] == (0, 0) and pieces[-1][2] == len(text)
    for i, (o, lo, hi) in enumerate(pieces):
        body = text[o:hi]
        if hi < len(text) and body.endswith("\n"):
            body = body[:-1]
        assert o <= lo < hi and len(body) <= S.MAX_CHARS and body.count("\n") + 1 <= S.MAX_LINES
        if i:
            # nothing can be shared where the lines before are empty of text or the next line fills the piece
            assert lo == pieces[i - 1][2] and (o < lo or hi - lo >= S.MAX_CHARS or text[:lo].endswith("\n\n"))
    return pieces


def test_pieces():
    text = "\n".join(f"    line {i}" for i in range(400))
    pieces = check(text)
    assert all(text.count("\n", o, lo) == 20 for o, lo, _ in pieces[1:])
    methods = "".join(f"def m{i}():\n" + "    x = 1\n" * 60 + "\n" for i in range(6))
    assert all(methods[lo:].startswith("def m") for _, lo, _ in check(methods))
    for _, lo, _ in check("x" * 30_000)[1:]:
        assert lo
    assert all(lo - o == 200 for o, lo, _ in check("ab, " * 9000)[1:])
    rng = random.Random(2)
    for _ in range(15):
        check("\n".join("w " * rng.choice([0, 3, 40, 3900, 4100]) for _ in range(rng.randint(160, 300))))
    check("\n" * 400)
    check("a" * 8001 + "\n")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=151, max_size=260))
def test_pieces_property(lengths):
    check("\n".join("k" * n for n in lengths))


def test_split_in_spark(spark):
    rows = [(1, "p:11-310", 9, 2, "sym", "\n".join("x" * 5 for _ in range(300))), (1, "p:11-310", 9, 2, "sym", "\n".join("x" * 5 for _ in range(300))), (2, None, None, None, None, "y" * 8001), (3, "q:1-1", 1, 1, None, None), (4, "q:1-150", 1, 150, None, "\n" * 149), (5, "bad", 7, 3, None, "\n" * 150)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "point_id bigint, chunk_id string, start_line int, end_line int, symbol_name string, content string, piece int")
    got = S.split_oversized(df).orderBy("point_id", "piece").collect()
    assert {r.point_id for r in got} == {1, 2, 5}
    one = [r for r in got if r.point_id == 1]
    assert one[0].start_line == 11 and one[-1].end_line == 310 and all(r.symbol_name == "sym" and r.end_line - r.start_line == r.content.count("\n") for r in one)
    assert all(b.start_line == a.end_line - 19 for a, b in zip(one, one[1:]))
    assert [r.start_line for r in got if r.point_id == 5][0] == 3 and [r.start_line for r in got if r.point_id == 2] == [1, 1]
    assert S.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(df, 10, 100, 10, 5)


def verify(counts, capacity):
    p = P.plan(dict(counts), capacity)
    used, seen, at = defaultdict(int), Counter(), set()
    for size, rank, n, base, position in p.slots:
        assert rank == seen[size]
        seen[size] += n
        for c in range(base, base + n):
            used[c] += size
            assert (c, position) not in at
            at.add((c, position))
    assert seen == Counter({k: v for k, v in counts.items() if v}) and len(used) == p.containers and max(used.values(), default=0) <= capacity
    return p.containers


def test_plans():
    rng = np.random.default_rng(1)
    for capacity in (1, 2, 7, 64, 300):
        for _ in range(25):
            verify(Counter(rng.integers(1, capacity + 1, size=rng.integers(0, 200)).tolist()), capacity)
    assert verify(Counter({1024: 1000}), 2048) == 500 and verify(Counter({2048: 3, 1: 2048}), 2048) == 4
    sizes = rng.integers(1, 900, size=5000)
    assert verify(Counter(sizes.tolist()), 2048) <= 1.02 * sizes.sum() / 2048


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.random((6, 9))
    x = np.maximum(rng.standard_normal(9), 0)
    got = P.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_pack_in_spark(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ROWS", 7)
    texts = [(i, "word " * (i % 9 + 1)) for i in range(120)] + [(500, "long " * 130), (501, ""), (502, None), (3, "word " * 4)] + [(600 + i, "hot") for i in range(60)]
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id bigint, text string, size int")
    rows = P.pack(df, 32).collect()
    placed = [r for r in rows if r.container is not None]
    assert {r.doc_id for r in rows if r.container is None} == {501, 502}
    used = Counter()
    for r in placed:
        used[r.container] += r["size"]
    assert max(used.values()) <= 32 and len({(r.container, r.position) for r in placed}) == len(placed) and set(used) == set(range(len(used)))
    tokens = {r.doc_id: r.tokens for r in P.token_counts(df).collect()}
    per = Counter()
    for r in placed:
        per[r.doc_id] += r["size"]
    assert per == Counter({k: v for k, v in tokens.items() if v})
    assert len([r for r in placed if r.doc_id == 500]) == -(-tokens[500] // 32)
    assert len({r.doc_id for r in placed}) == len([k for k, v in tokens.items() if v])
    f = P.filling(P.pack(df, 32), 32).first()
    assert f.containers == len(used) and f.tokens == sum(used.values())
    assert P.pack(df.limit(0), 32).count() == 0 and P.filling(P.pack(df.limit(0), 32), 32).first().containers == 0


def test_filling_of_varied_texts(spark):
    """Texts of the lengths a crawl has: within one percent of the least number of containers at every capacity."""
    rng = np.random.default_rng(9)
    lengths = np.clip(rng.lognormal(5.2, 1.1, 3000), 3, 9000).astype(int)
    df = spark.createDataFrame([(i, " ".join(["word"] * int(n))) for i, n in enumerate(lengths)], "doc_id bigint, text string").repartition(4).cache()
    for capacity in (512, 2048, 8192):
        f = P.filling(P.pack(df, capacity), capacity).first()
        assert f.containers <= 1.01 * f.least_containers + 1, (capacity, f)
