"""Texts packed into containers of a fixed number of tokens, planned on the histogram of lengths.

1. Texts are measured in tokens of a public tokenizer. A text over the capacity becomes full containers of its own and one rest;
   every other text is one item and is never split.
2. The histogram of item sizes has at most ``capacity`` rows whatever the corpus, and is all the driver sees. It is binned;
   shallow combinations of bins that fill a container are enumerated, and non-negative least squares gives how often each is
   used so that they meet the histogram. Counts are rounded down; what is left is packed best-fit, longest first, into the space of
   planned and new containers. All of this works on runs (size, count), so its cost does not depend on the number of texts.
3. Each item's rank among those of its size, counted in salted groups, selects its slot by binary search in the plan.

Null, empty and token-less texts have size 0 and need no container: they come out with a null container and position.
Repeated rows of a document count once; the one with the greatest size is kept should they differ.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable, require

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of that vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs of bins of the histogram in the least-squares step, and items of a combination at most; the plan with the fewest containers is kept.
SHAPES = ((32, 3), (32, 2), (64, 3), (64, 2), (128, 2), (192, 2))
#: Items ranked in one group; more of one size are salted.
GROUP_ROWS = 500_000


_MADE: dict[str, object] = {}


def _encoding(name: str, vocabulary: bytes):
    """The tokenizer of a vocabulary; made once in a process."""
    import tiktoken

    if name not in _MADE:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _MADE[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _MADE[name]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of the whole text; null has 0. The vocabulary file is read by the driver and sent to the executors, a megabyte or so."""
    vocabulary = Path(tokenizer).read_bytes()
    name = f"{tokenizer}-{hashlib.sha1(vocabulary).hexdigest()}"
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(name, shared.value).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return require(documents, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, tokens bigint")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(w).max(initial=0)))
    for _ in range(10 * n):
        free = np.where(~active, w, -np.inf)
        j = int(free.argmax())
        if free[j] <= tol:
            break
        active[j] = True
        while True:
            cols = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[cols] = s
                break
            low = s <= 0
            step = np.min(x[cols][low] / np.maximum(x[cols][low] - s[low], 1e-300))
            x[cols] += step * (s - x[cols])
            x[cols[low & (x[cols] <= 1e-12 * max(1.0, x.max()))]] = 0
            drop = cols[x[cols] <= 0]
            if not len(drop):
                drop = cols[[int(s.argmin())]]
                x[drop] = 0
            active[drop] = False
        w = a.T @ (b - a @ x)
    return x


def combinations(bins: int, depth: int, slack: int = 1) -> list[tuple[int, ...]]:
    """Multisets of at most depth bins, largest first, whose sum is within slack of the whole window."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int) -> None:
        if prefix and left <= slack:
            out.append(prefix)
        if len(prefix) < depth:
            for b in range(min(left, prefix[-1] if prefix else left), 0, -1):
                grow((*prefix, b), left - b)

    grow((), bins)
    return out


class Plan:
    """Slots as parallel lists: for items of size, ranks [rank, rank + n) go to containers [base, base + n), at position."""

    def __init__(self, capacity: int, counts: dict[int, int]) -> None:
        self.capacity = capacity
        self.left = {s: c for s, c in counts.items() if c}
        self.next_rank: dict[int, int] = defaultdict(int)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.containers = 0
        #: free space -> groups [base, containers, items in each]
        self.space: dict[int, list[list[int]]] = defaultdict(list)
        self.spaces: list[int] = []

    def _put(self, size: int, n: int, base: int, position: int) -> None:
        self.slots.append((size, self.next_rank[size], n, base, position))
        self.next_rank[size] += n
        self.left[size] -= n

    def _free(self, space: int, group: list[int]) -> None:
        if space > 0:
            if not self.space[space]:
                insort(self.spaces, space)
            self.space[space].append(group)

    def combine(self, stocks: list[list[int]], n: int) -> None:
        """n containers with one item of each stock; a stock is a list of sizes, used from its end."""
        while n:
            while any(not self.left.get(s[-1]) for s in stocks):
                for s in stocks:
                    while s and not self.left.get(s[-1]):
                        s.pop()
            heads = [s[-1] for s in stocks]
            k = min([n, *(self.left[h] // heads.count(h) for h in heads)])
            if not k:
                # one size stands in several slots but has too few items for all of them
                for i, h in enumerate(heads):
                    if heads.count(h) > self.left[h]:
                        stocks[i].pop()
                        break
                if any(not s for s in stocks):
                    return
                continue
            for position, h in enumerate(heads):
                self._put(h, k, self.containers, position)
            self._free(self.capacity - sum(heads), [self.containers, k, len(heads)])
            self.containers += k
            n -= k

    def best_fit(self) -> None:
        for size in sorted(self.left, reverse=True):
            while self.left[size]:
                at = bisect_left(self.spaces, size)
                if at < len(self.spaces):
                    space = self.spaces[at]
                    base, n, items = self.space[space].pop()
                    if not self.space[space]:
                        self.spaces.pop(at)
                else:
                    space, base, items = self.capacity, self.containers, 0
                    n = -(-self.left[size] // (space // size))
                    self.containers += n
                each = space // size
                full = min(n, self.left[size] // each)
                for p in range(each if full else 0):
                    self._put(size, full, base, items + p)
                if full:
                    self._free(space - each * size, [base, full, items + each])
                rest = min(self.left[size], each - 1) if full < n else 0
                for p in range(rest):
                    self._put(size, 1, base + full, items + p)
                if rest:
                    self._free(space - rest * size, [base + full, 1, items + rest])
                if full + bool(rest) < n:
                    self._free(space, [base + full + bool(rest), n - full - bool(rest), items])


def plan(counts: dict[int, int], capacity: int, shapes: tuple[tuple[int, int], ...] = SHAPES) -> Plan:
    """The best plan over some shapes. Each costs a fraction of a second, whatever the number of texts."""
    floor = -(-sum(s * c for s, c in counts.items()) // capacity)
    best = None
    for bins, depth in shapes:
        p = shaped_plan(counts, capacity, bins, depth)
        if best is None or p.containers < best.containers:
            best = p
        if best.containers == floor:
            break
    return best


def shaped_plan(counts: dict[int, int], capacity: int, bins: int, depth: int) -> Plan:
    p = Plan(capacity, counts)
    bins = min(bins, capacity)
    of = lambda size: -(-size * bins // capacity)
    hist = np.zeros(bins)
    sizes: dict[int, list[int]] = defaultdict(list)
    for s in sorted(p.left):
        hist[of(s) - 1] += p.left[s]
        sizes[of(s)].append(s)
    ways = combinations(bins, depth)
    a = np.zeros((bins, len(ways)))
    for j, way in enumerate(ways):
        for b in way:
            a[b - 1, j] += 1
    # long items count more: a short one finds a place later
    weight = np.sqrt(np.arange(1, bins + 1))
    x = nnls(a * weight[:, None], hist * weight)
    for j in np.argsort(-x, kind="stable"):
        way = ways[j]
        have = {b: sum(p.left[s] for s in sizes[b]) for b in set(way)}
        n = min([int(x[j]), *(have[b] // way.count(b) for b in have)])
        if n > 0:
            # the longest of one bin beside the shortest of the next keeps the filling even
            p.combine([[s for s in (sizes[b] if i % 2 == 0 else sizes[b][::-1]) if p.left[s]] for i, b in enumerate(way)], n)
    p.best_fit()
    return p


def pack(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_id, position, size, doc_offset): position counts items in a container from 0, size and doc_offset are tokens."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    counted = token_counts(documents, tokenizer).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    size = F.least(F.lit(capacity), F.col("tokens") - F.col("doc_offset"))
    last = F.greatest(F.floor((F.col("tokens") - 1) / capacity), F.lit(0))
    items = reliable(counted.select("doc_id", "tokens", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: k * capacity)).alias("doc_offset")).select("doc_id", "doc_offset", size.cast("int").alias("size")))
    counts = {r.size: r.n for r in items.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).toLocalIterator()}
    salts = {s: -(-c // GROUP_ROWS) for s, c in counts.items()}
    salt_of = F.coalesce(F.element_at(F.create_map([F.lit(x) for s, k in salts.items() if k > 1 for x in (s, k)]), F.col("size")), F.lit(1)) if any(k > 1 for k in salts.values()) else F.lit(1)
    salted = items.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_offset"), salt_of).cast("int"))
    offsets: dict[tuple[int, int], int] = {(s, 0): 0 for s in counts}
    many = [s for s, k in salts.items() if k > 1]
    if many:
        # one row for GROUP_ROWS items
        seen: dict[int, int] = defaultdict(int)
        for r in salted.where(F.col("size").isin(many)).groupBy("size", "salt").agg(F.count("*").alias("n")).orderBy("size", "salt").toLocalIterator():
            offsets[(r.size, r.salt)] = seen[r.size]
            seen[r.size] += r.n
    p = plan(counts, capacity)
    slots = np.array(sorted(p.slots), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((slots, offsets))
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "doc_offset")) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, offsets = shared.value
        width = int(slots[:, 1].max(initial=0)) + 1
        keys = slots[:, 0] * width + slots[:, 1]
        for b in batches:
            size, salt, rn = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "salt", "rn"))
            pairs, inverse = np.unique(size * (1 << 32) + salt, return_inverse=True)
            base = np.array([offsets[(int(x) >> 32, int(x) & 0xFFFFFFFF)] for x in pairs], np.int64)
            rank = rn + (base[inverse] if len(base) else 0)
            at = np.searchsorted(keys, size * width + rank, side="right") - 1
            container = slots[at, 3] + rank - slots[at, 1]
            yield pa.RecordBatch.from_arrays([pa.array(container, pa.int64()), b.column("doc_id"), pa.array(slots[at, 4].astype(np.int32)), b.column("size"), b.column("doc_offset").cast(pa.int64())], names=["container", "doc_id", "position", "size", "doc_offset"])

    placed = ranked.mapInArrow(place, "container bigint, doc_id bigint, position int, size int, doc_offset bigint")
    nothing = items.where("size = 0").select(F.lit(None).cast("bigint").alias("container"), "doc_id", F.lit(None).cast("int").alias("position"), "size", "doc_offset")
    return placed.unionByName(nothing)


def filling(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, the least number of containers possible, and the share of space used."""
    used = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    out = used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    return out.select("containers", "items", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1)), 6).alias("filled"))
