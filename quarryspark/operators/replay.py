"""Control-plane state machines replayed over logs: the sliding-window limiter and the least-recently-used answer cache.

Both are folds over the calls of a key in order. Rows are partitioned by key and sorted, then each partition is streamed through a fold
whose state is bounded by the limit or the number of entries; no key's calls are ever gathered. A limiter with one global key is inherently
sequential: it streams through one task in constant memory.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..errors import EngineError


class RateLimiter:
    """At most ``calls`` in the last ``seconds``; a denied call is not recorded."""

    def __init__(self, calls: int = LIMITS.rate_calls, seconds: float = LIMITS.rate_seconds) -> None:
        self.calls, self.seconds = calls, seconds
        self.times: deque[float] = deque()

    def allow(self, now: float) -> bool:
        while self.times and now - self.times[0] >= self.seconds:
            self.times.popleft()
        if len(self.times) >= self.calls:
            return False
        self.times.append(now)
        return True

    def check(self, now: float) -> None:
        if not self.allow(now):
            raise EngineError("too many calls", 429)


class AnswerCache:
    """Least recently used entries go first; keys begin with the repository, and hold the index version."""

    def __init__(self, entries: int = LIMITS.cache_entries) -> None:
        self.entries = entries
        self.kept: OrderedDict[tuple, Any] = OrderedDict()

    def get(self, key: tuple) -> Any | None:
        if key not in self.kept:
            return None
        self.kept.move_to_end(key)
        return self.kept[key]

    def put(self, key: tuple, value: Any) -> None:
        self.kept[key] = value
        self.kept.move_to_end(key)
        while len(self.kept) > self.entries:
            self.kept.popitem(last=False)

    def invalidate(self, owner: str, name: str) -> None:
        for key in [k for k in self.kept if k[:2] == (owner, name)]:
            del self.kept[key]


def _fold(log: DataFrame, columns: list[str], key: str, order: list[str], make: Callable[[], Callable[[tuple], Any]], result: str, kind: str) -> DataFrame:
    types = {"boolean": pa.bool_()}
    rows = log.select(*columns).repartition(F.col(key)).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in columns)):
                if row[columns.index(key)] != current:
                    current, step = row[columns.index(key)], make()
                out.append(step(row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, types[kind])], names=[*columns, result])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {result} {kind}")


def rate_limit(events: DataFrame, key: str = "user_id", calls: int = LIMITS.rate_calls, seconds: float = LIMITS.rate_seconds) -> DataFrame:
    """Events (event_id, key, second) with allowed; null times come first and are treated as second 0."""

    def make():
        limiter = RateLimiter(calls, seconds)
        return lambda row: limiter.allow(row[2] or 0.0)

    log = events.select("event_id", key, F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros")).withColumn("second", F.col("micros") / 1e6)
    return _fold(log, ["event_id", key, "second"], key, ["second", "event_id"], make, "allowed", "boolean")


def trailing_calls(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(event_id, n): calls of the event's key in the seconds before it, itself included.

    A key is cut into spans of the window's length; each event is seen by its own span and the next, so a busy key is spread over its
    spans and no task holds more than two of them.
    """
    width = seconds * 1_000_000
    e = events.select("event_id", key, F.unix_micros(F.col("ts").cast("timestamp")).alias("s"))
    span = F.floor(F.col("s") / width)
    seen = e.select("event_id", key, "s", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))).alias("x")).select("event_id", key, "s", "x.*")
    w = Window.partitionBy(key, "span").orderBy("s").rangeBetween(1 - width, 0)
    return seen.withColumn("n", F.count("*").over(w)).where("own").select("event_id", "n")


def cache_hits(requests: DataFrame, key: str, entries: int = LIMITS.cache_entries) -> DataFrame:
    """Requests (event_id, key, second, request) with hit: whether the answer is still cached for the key's cache."""

    def make():
        cache = AnswerCache(entries)

        def step(row):
            hit = cache.get((row[3],)) is not None
            cache.put((row[3],), True)
            return hit

        return step

    return _fold(requests, ["event_id", key, "second", "request"], key, ["second", "event_id"], make, "hit", "boolean")
