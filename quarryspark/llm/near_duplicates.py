"""Near-duplicate chunks by a set-similarity join with vertical partitioning.

Every content is the set of its runs of three consecutive tokens. The join is exact:

1. Exact copies are folded into classes first, with a map-side combine, so a text that fills a third
   of the table is one row from here on.
2. Grams are hashed and cut by hash range into *counting fragments*, as many as keep each under ``GROUP_BYTES``; the length of all texts is
   measured first. Each fragment is a task of its own and counts in how many texts each of its grams occurs. Grams of one text only are dropped, they cannot overlap anything.
   A gram that is frequent within one batch travels as (gram, count) while its postings go past the fragment
   straight back to their batch, so no fragment grows with the frequency of one gram.
3. The global gram order is (document frequency, hash). A text's prefix is its first n - ceil(t n) + 1 grams in that
   order: two similar texts share a gram of their prefixes. Postings of prefixes are joined, salted into
   blocks by document frequency.
4. The global order is cut into *overlap fragments* at powers of two of document frequency. For each candidate pair
   the overlap of each fragment is counted separately, on its own row, and the counts are summed per pair.

Pairs of copies are listed from blocks of ``SPREAD`` members of their class against the whole class, so a class that holds a third
of the table is spread over many tasks.

Null contents and contents under ``min_tokens`` tokens are in no pair. Repeated rows of a point count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable, require

#: Numerator and denominator of the least Jaccard similarity; integers keep the test exact.
THRESHOLD = (7, 10)
MIN_TOKENS = 40
NGRAM = 3
#: Texts per batch at most; bounds the memory of a batch whatever the size of a partition.
BATCH = 16_384
#: Grams per batch at most, for very long texts.
BATCH_GRAMS = 4_000_000
#: Postings of one gram in one batch from which they travel outside the counting fragments.
HOT = 256
#: Overlap fragments of the global order.
FRAGMENTS = 8
#: Postings of one gram joined in one block.
BLOCK = 1024
#: Bytes of grams that one counting fragment holds, about; a task needs some six times as much.
GROUP_BYTES = 16_000_000
#: Members of a class of copies that are joined in one block.
SPREAD = 1024

_TOKEN = re.compile(rb"[a-z0-9_]+")
_MASK = np.uint64((1 << 48) - 1)


def _token_hashes(content: str, known: dict[bytes, int]) -> np.ndarray:
    tokens = _TOKEN.findall(content.encode("ascii", "replace").lower())
    out = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        h = known.get(t)
        if h is None:
            h = known[t] = xxhash.xxh3_64_intdigest(t)
        out[i] = h
    return out


def gram_set(content: str | None, known: dict[bytes, int], min_tokens: int = MIN_TOKENS, n: int = NGRAM) -> np.ndarray | None:
    """Sorted distinct 48-bit gram hashes, None if the text has too few tokens.

    Two given texts of a few hundred grams share a wrong gram with a probability of about 1e-10.
    """
    if content is None:
        return None
    v = _token_hashes(content, known)
    if len(v) < max(min_tokens, n):
        return None
    m = len(v) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = (h ^ v[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique((h >> np.uint64(13)) & _MASK)


_BLOCKS = pa.schema([("frag", pa.int32()), ("kind", pa.int8()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
IDS, RARE, FREQUENT, POSTINGS = 0, 1, 2, 3


def _pack(h: np.ndarray) -> tuple[bytes, bytes]:
    """Low and high parts; the high one is sorted and costs next to nothing once compressed."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (h >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32))


def _emit_batch(batch: int, ids: list[int], sets: list[np.ndarray], fragments: int) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, own = grams[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    counts = np.diff(np.append(first, len(grams)))
    hot = np.repeat(counts > HOT, counts)
    rows: list[tuple] = [(fragments + batch % fragments, IDS, batch, np.array(ids, np.int64).tobytes(), sizes.tobytes(), b"")]
    if hot.any():
        rows.append((fragments + batch % fragments, POSTINGS, batch, *_pack(grams[hot]), own[hot].tobytes()))
    hot_grams, hot_counts = grams[first][counts > HOT], counts[counts > HOT]
    grams, own = grams[~hot], own[~hot]
    edges = (np.arange(fragments + 1, dtype=np.float64) * (float(1 << 48) / fragments)).astype(np.uint64)
    at, hot_at = np.searchsorted(grams, edges), np.searchsorted(hot_grams, edges)
    for f in range(fragments):
        if at[f] < at[f + 1]:
            s = slice(at[f], at[f + 1])
            rows.append((f, RARE, batch, *_pack(grams[s]), own[s].tobytes()))
        if hot_at[f] < hot_at[f + 1]:
            s = slice(hot_at[f], hot_at[f + 1])
            rows.append((f, FREQUENT, batch, *_pack(hot_grams[s]), hot_counts[s].astype(np.int64).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCKS.types)], schema=_BLOCKS)


def _shingler(fragments: int, min_tokens: int, ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids: list[int] = []
        sets: list[np.ndarray] = []
        grams = 0
        for b in batches:
            for rid, content in zip(b.column("rid").to_pylist(), b.column("content").to_pylist()):
                s = gram_set(content, known, min_tokens, ngram)
                if len(known) > 2_000_000:
                    known.clear()
                if s is None:
                    continue
                ids.append(rid)
                sets.append(s)
                grams += len(s)
                if len(ids) >= BATCH or grams >= BATCH_GRAMS:
                    yield _emit_batch(xxhash.xxh3_64_intdigest(str(ids[0])) >> 1, ids, sets, fragments)
                    ids, sets, grams = [], [], 0
        if ids:
            yield _emit_batch(xxhash.xxh3_64_intdigest(str(ids[0])) >> 1, ids, sets, fragments)

    return run


_COUNTED = pa.schema([("batch", pa.int64()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _count_fragment(t: pa.Table) -> pa.Table:
    """Document frequency of the grams of one fragment; what is in one text only is dropped."""
    rows: list[tuple] = []
    parts = t.select(["kind", "batch", "a", "b", "c"]).to_pylist()
    for p in parts:
        if p["kind"] in (IDS, POSTINGS):
            rows.append((p["batch"], p["kind"], p["a"], p["b"], p["c"], b""))
    parts = [p for p in parts if p["kind"] in (RARE, FREQUENT)]
    if parts:
        hashes = [_unpack(p["a"], p["b"]) for p in parts]
        weights = [np.ones(len(h), np.int64) if p["kind"] == RARE else np.frombuffer(p["c"], np.int64) for p, h in zip(parts, hashes)]
        keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        # exact for counts below 2**53
        df = np.bincount(inverse, weights=np.concatenate(weights)).astype(np.int64)
        at = 0
        for p, h in zip(parts, hashes):
            d = df[inverse[at : at + len(h)]]
            at += len(h)
            keep = d > 1
            if keep.any():
                c = p["c"] if p["kind"] == FREQUENT else np.frombuffer(p["c"], np.uint16)[keep].tobytes()
                rows.append((p["batch"], p["kind"], *_pack(h[keep]), c, d[keep].tobytes()))
    return pa.table([pa.array(c, ty) for c, ty in zip(zip(*rows) if rows else [[]] * 6, _COUNTED.types)], schema=_COUNTED)


_RECORDS = pa.schema([("rid", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("prefix", pa.list_(pa.int64())), ("prefix_df", pa.list_(pa.int64())), ("segments", pa.list_(pa.list_(pa.int64())))])


def _batch_records(threshold: tuple[int, int], fragments: int):
    num, den = threshold

    def run(t: pa.Table) -> pa.Table:
        ids = sizes = None
        grams, own, freq, lookup, direct = [], [], [], [], []
        for p in t.to_pylist():
            if p["kind"] == IDS:
                ids, sizes = np.frombuffer(p["a"], np.int64), np.frombuffer(p["b"], np.int64)
                continue
            h = _unpack(p["a"], p["b"])
            if p["kind"] == RARE:
                grams.append(h)
                own.append(np.frombuffer(p["c"], np.uint16))
                freq.append(np.frombuffer(p["d"], np.int64))
            elif p["kind"] == FREQUENT:
                lookup.append((h, np.frombuffer(p["d"], np.int64)))
            else:
                direct.append((h, np.frombuffer(p["c"], np.uint16)))
        if direct:
            keys, dfs = np.concatenate([x for x, _ in lookup]), np.concatenate([x for _, x in lookup])
            o = np.argsort(keys)
            keys, dfs = keys[o], dfs[o]
            for h, who in direct:
                grams.append(h)
                own.append(who)
                freq.append(dfs[np.searchsorted(keys, h)])
        out: list[tuple] = []
        if grams and ids is not None:
            g, w, d = np.concatenate(grams).astype(np.int64), np.concatenate(own), np.concatenate(freq)
            o = np.lexsort((g, d, w))
            g, w, d = g[o], w[o], d[o]
            ends = np.searchsorted(w, np.arange(len(ids) + 1))
            level = np.minimum(np.log2(d).astype(np.int64) - 1, fragments - 1)
            for k in range(len(ids)):
                lo, hi = ends[k], ends[k + 1]
                n = int(sizes[k])
                rare = n - int(hi - lo)
                left = n - -(-num * n // den) + 1 - rare
                if left <= 0:
                    continue
                cuts = lo + np.searchsorted(level[lo:hi], np.arange(fragments + 1))
                out.append((int(ids[k]), n, rare, g[lo : min(hi, lo + left)], d[lo : min(hi, lo + left)], [g[a:b] for a, b in zip(cuts, cuts[1:])]))
        return pa.table([pa.array(list(c), ty) for c, ty in zip(zip(*out) if out else [[]] * 6, _RECORDS.types)], schema=_RECORDS)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int8(): "tinyint", pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}

    def of(t: pa.DataType) -> str:
        return f"array<{of(t.value_type)}>" if pa.types.is_list(t) else kinds[t]

    return ", ".join(f"{f.name} {of(f.type)}" for f in schema)


def _hashes():
    return F.xxhash64("content").alias("h1"), F.xxhash64(F.concat(F.lit("."), "content")).alias("h2")


def content_classes(chunks: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Classes of equal content: rid (least point), content."""
    rows = require(chunks, "point_id", "content").where("point_id IS NOT NULL AND content IS NOT NULL")
    return rows.groupBy(*_hashes()).agg(F.min("point_id").alias("rid"), F.first("content").alias("content")).where(F.length("content") >= 2 * min_tokens - 1)


def membership(chunks: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(point_id, rid, copies, chars): every point with enough tokens, the least point of equal content, the points of that class and the content's length. Settled, as several plans read it."""
    rows = require(chunks, "point_id", "content").where("point_id IS NOT NULL AND content IS NOT NULL").where(F.length("content") >= 2 * min_tokens - 1)
    keyed = rows.select("point_id", *_hashes(), F.length("content").alias("chars"), (F.regexp_count("content", F.lit("[A-Za-z0-9_]+")) >= min_tokens).alias("enough"))
    keyed = keyed.where("enough").drop("enough").distinct()
    classes = keyed.groupBy("h1", "h2").agg(F.min("point_id").alias("rid"), F.count("*").alias("copies"))
    return reliable(keyed.join(classes, ["h1", "h2"]).select("point_id", "rid", "copies", "chars"))


def similar_classes(chunks: DataFrame, member: DataFrame, threshold: tuple[int, int] = THRESHOLD, min_tokens: int = MIN_TOKENS, ngram: int = NGRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pairs (rid_a, rid_b, overlap, n_a, n_b) of different contents, rid_a < rid_b, whose sets are alike."""
    spark = chunks.sparkSession
    num, den = threshold
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a token and the sign after it take five characters or more in most texts, and a gram travels as eight bytes
    size = 8 * (member.where("point_id = rid").agg(F.sum("chars")).first()[0] or 0) // 5
    fragments = max(partitions, -(-size // group_bytes))
    batches = max(partitions, 2 * -(-size // (8 * BATCH_GRAMS)))
    # sorted, so that a task that runs again after a lost executor makes the same batches
    texts = content_classes(chunks, min_tokens).select("rid", "content").sortWithinPartitions("rid")
    blocks = texts.mapInArrow(_shingler(fragments, min_tokens, ngram), _ddl(_BLOCKS))
    # the second half of the partitions only hands rows through
    counted = blocks.repartitionById(2 * fragments, "frag").groupBy("frag").applyInArrow(_count_fragment, _ddl(_COUNTED))
    records = reliable(counted.repartition(batches, "batch").groupBy("batch").applyInArrow(_batch_records(threshold, FRAGMENTS), _ddl(_RECORDS)))
    posts = records.select("rid", "n", "rare", F.posexplode(F.arrays_zip("prefix", "prefix_df")).alias("at", "g")).select("rid", "n", (F.col("n") - F.col("rare") - F.col("at") - 1).alias("after"), F.col("g.prefix").alias("gram"), F.ceil(F.col("g.prefix_df") / BLOCK).cast("int").alias("blocks"))
    left = posts.select("gram", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"), F.col("rid").alias("a"), F.col("n").alias("na"), F.col("after").alias("after_a"))
    right = posts.select("gram", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("after").alias("after_b"))
    near = (
        left.join(right, ["gram", "block"])
        .where("a < b")
        .where(f"least(na, nb) * {den} >= {num} * greatest(na, nb)")
        # the first gram two texts share bounds their overlap by what is left after it in either
        .groupBy("a", "b", "na", "nb")
        .agg(F.max(F.least("after_a", "after_b")).alias("after"))
        .where(f"(after + 1) * {num + den} >= {num} * (na + nb)")
    )
    segments = records.select("rid", F.posexplode("segments").alias("frag", "grams")).where(F.size("grams") > 0)
    partial = (
        near.join(segments.select(F.col("rid").alias("a"), "frag", F.col("grams").alias("ga")), "a")
        .join(segments.select(F.col("rid").alias("b"), "frag", F.col("grams").alias("gb")), ["b", "frag"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    )
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap")).where(f"overlap * {num + den} >= {num} * (na + nb)").select(F.col("a").alias("rid_a"), F.col("b").alias("rid_b"), "overlap", F.col("na").alias("n_a"), F.col("nb").alias("n_b"))


def near_duplicate_pairs(chunks: DataFrame, threshold: tuple[int, int] = THRESHOLD, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """All pairs (point_id_a, point_id_b), a < b, of different points whose contents are alike, equal contents included.

    A class of n copies is n squared over two pairs by definition; they come from n / ``SPREAD`` blocks of it, each with the whole class.
    """
    member = membership(chunks, min_tokens)
    pairs = similar_classes(chunks, member, threshold, min_tokens)
    blocks = F.ceil(F.col("copies") / SPREAD).cast("int")
    own = member.select("rid", F.pmod(F.xxhash64("point_id"), blocks).cast("int").alias("block"), "point_id")
    every = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    sizes = member.where("point_id = rid").select("rid", every)
    side = lambda k, p: own.select(F.col("rid").alias(f"rid_{k}"), F.col("block").alias(f"block_{k}"), F.col("point_id").alias(p))
    split = lambda k: sizes.select(F.col("rid").alias(f"rid_{k}"), F.col("block").alias(f"block_{k}"))
    between = pairs.select("rid_a", "rid_b").join(split("a"), "rid_a").join(side("a", "p"), ["rid_a", "block_a"]).select("p", "rid_b").join(split("b"), "rid_b").join(side("b", "q"), ["rid_b", "block_b"]).select("p", "q")
    copied = member.where("copies > 1")
    whole = copied.select(F.col("rid").alias("rid_a"), every.alias("block_a"), F.col("point_id").alias("q"))
    within = side("a", "p").join(whole, ["rid_a", "block_a"]).where("p < q").select("p", "q")
    return between.unionByName(within).select(F.least("p", "q").alias("point_id_a"), F.greatest("p", "q").alias("point_id_b"))


def near_duplicate_links(chunks: DataFrame, threshold: tuple[int, int] = THRESHOLD, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row per point with enough tokens: class_id (least point of equal content), copies (points of that class)
    and links (other classes that are alike)."""
    member = membership(chunks, min_tokens)
    pairs = similar_classes(chunks, member, threshold, min_tokens)
    links = pairs.select(F.explode(F.array("rid_a", "rid_b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    return member.join(links, "rid", "left").select("point_id", F.col("rid").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
