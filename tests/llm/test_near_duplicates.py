import random
import re

from quarryspark.llm import near_duplicates as N

CHUNK = "point_id bigint, content string"


def grams(text):
    w = [t.lower() for t in re.findall(r"[A-Za-z0-9_]+", text or "")]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 40 else None


def brute(rows):
    first = {}
    for p, t in rows:
        if p is not None and grams(t) is not None:
            first[p] = grams(t)
    ids = sorted(first)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 10 * len(first[a] & first[b]) >= 7 * len(first[a] | first[b])}


def fixture():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(copy))
                if rng.random() < 0.4:
                    copy.insert(at, rng.choice(words))
                else:
                    copy[at] = rng.choice(words)
            n += 1
            rows.append((n, " ".join(copy)))
    boiler = " ".join(f"licence{i}" for i in range(44))
    for i in range(90):
        # a third of the rows share most of their grams, each with an ending of its own
        rows.append((1000 + i, f"{boiler} own{i} tail{i}"))
    rows += [(2000 + i, "same " * 50) for i in range(20)]
    rows += [(2000, "same " * 50), (3000, None), (3001, ""), (3002, "K İ é " * 60), (None, "x " * 60), (3003, "k e " * 60)]
    return rows


def test_pairs_equal_brute_force(spark, monkeypatch):
    rows = fixture()
    for hot, batch in ((N.HOT, N.BATCH), (8, 40)):
        monkeypatch.setattr(N, "HOT", hot)
        monkeypatch.setattr(N, "BATCH", batch)
        df = spark.createDataFrame([(p, t, 1) for p, t in rows], CHUNK + ", rid int")
        got = [(r.point_id_a, r.point_id_b) for r in N.near_duplicate_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_blocks_and_links(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "SPREAD", 3)
    monkeypatch.setattr(N, "GROUP_BYTES", 900)
    rows = fixture()
    df = spark.createDataFrame(rows, CHUNK)
    assert {(r.point_id_a, r.point_id_b) for r in N.near_duplicate_pairs(df).collect()} == brute(rows)
    links = {r.point_id: r for r in N.near_duplicate_links(df).collect()}
    assert links[2005].class_id == 2000 and links[2005].copies == 20 and links[2005].links == 0
    assert links[1003].links == len([p for p in brute(rows) if 1003 in p])


def test_class_of_many_copies(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(90))
    rows = [(i, text) for i in range(20_000)] + [(50_000, text + " tail"), (50_001, " ".join(f"v{i}" for i in range(80)))]
    df = spark.createDataFrame(rows, CHUNK)
    assert {(r.class_id, r.copies, r.links, r["count"]) for r in N.near_duplicate_links(df).groupBy("class_id", "copies", "links").count().collect()} == {(0, 20_000, 1, 20_000), (50_000, 1, 1, 1), (50_001, 1, 0, 1)}
    small = df.where("point_id < 1500 OR point_id >= 50000")
    assert N.near_duplicate_pairs(small).count() == N.near_duplicate_pairs(small).distinct().count() == 1500 * 1499 // 2 + 1500


def test_empty(spark):
    assert N.near_duplicate_pairs(spark.createDataFrame([], CHUNK)).count() == 0
    assert N.near_duplicate_pairs(spark.createDataFrame([(1, None), (2, "a b")], CHUNK)).count() == 0
