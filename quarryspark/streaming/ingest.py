"""Structured Streaming: continuous chunking of arriving files, and a stateful limiter over a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import LIMITS
from ..operators.replay import RateLimiter
from ..operators.scan import skip_reason
from ..operators.symbol_chunks import symbol_chunks


def stream_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet file tables with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def chunk_stream(files: DataFrame) -> DataFrame:
    """Chunks of selected files as they arrive: row-local, so no state is kept. files hold owner, name, path, content."""
    reason = skip_reason(F.col("path"), F.octet_length("content"), F.col("content"))
    return symbol_chunks(files.where(reason.isNull()))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str):
    """Exactly-once Parquet sink, partitioned by repository, over all input that is there."""
    return chunks.writeStream.format("parquet").partitionBy("owner", "name").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def limit_stream(calls: DataFrame, limit: int = LIMITS.rate_calls, seconds: float = LIMITS.rate_seconds, idle: float | None = None) -> DataFrame:
    """calls(key string, second double) with allowed; state is the recent admitted calls of a key, at most ``limit`` numbers.

    With ``idle``, a key that makes no call for the longer of these seconds and the limiter's own window is forgotten, so the state of a stream that runs on does not
    grow with all keys ever seen. Such a stream wakes up to forget, so it never ends by itself: leave ``idle`` out under a trigger that stops once all input is read.
    """
    wait = int(1000 * max(idle or 0.0, seconds))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = RateLimiter(limit, seconds)
        if state.exists:
            limiter.times.extend(state.get[0])
        for b in batches:
            b = b.sort_values("second")
            yield b.assign(allowed=[limiter.allow(t) for t in b["second"]])[["key", "second", "allowed"]]
        state.update((list(limiter.times),))
        if idle is not None:
            state.setTimeoutDuration(wait)

    return calls.groupBy("key").applyInPandasWithState(step, "key string, second double, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Calls per user and window of a stream of events(ts, user_id); late rows beyond the delay are closed out by the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")
