"""Dense vectors: a hashed term-frequency embedder and exact top-k search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import code_token_bag

#: Bytes of the query vectors that are broadcast at once, and of the scores a task holds at once.
QUERY_BYTES, SCORE_BYTES = 4_000_000, 16_000_000


def bucket(token, dimensions: int = LIMITS.dimensions):
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 6), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")


def term_buckets(rows: DataFrame, key: str, text: str, dimensions: int = LIMITS.dimensions) -> DataFrame:
    """(key, bucket, n): how many tokens of a text fall into each bucket."""
    return rows.select(key, F.explode_outer(code_token_bag(F.col(text))).alias("t")).where("t IS NOT NULL").select(key, bucket(F.col("t"), dimensions).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("n"))


def embed(rows: DataFrame, key: str, text: str, dimensions: int = LIMITS.dimensions) -> DataFrame:
    """(key, embedding): normalised bucket counts; a text without a token has no vector. The default embedder, made of native functions."""
    per = term_buckets(rows, key, text, dimensions).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return per.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)) / F.col("norm")).alias("embedding"))


def _rows(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, which rows it holds) of a list column; vectors of another length are left out."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(lengths == dimensions)
    if len(keep) < len(column):
        column = column.take(pa.array(keep))
    return column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dimensions), keep


def best(q: np.ndarray, keys: np.ndarray, x: np.ndarray, limit: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, scores) of the ``limit`` nearest rows of x for each row of q; equal scores go to the lesser key. Scores are made in blocks of bounded size."""
    order = np.argsort(keys, kind="stable")
    keys, x = keys[order], x[order]
    size = max(1, SCORE_BYTES // (8 * max(1, len(q))))
    scale = 10**places
    found_keys, found = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
    for at in range(0, len(keys), size):
        part = x[at : at + size]
        n = len(part)
        # the rounded score and the place among rows in order of key in one number, so that no two are equal
        score = np.rint(q @ part.T * scale).astype(np.int64)
        rank = score * n + np.arange(n - 1, -1, -1)
        if n > limit:
            rank = -np.partition(-rank, limit - 1, axis=1)[:, :limit]
        found = np.concatenate([found, rank // n], axis=1)
        found_keys = np.concatenate([found_keys, keys[at : at + size][n - 1 - rank % n]], axis=1)
        if found.shape[1] > limit:
            top = np.lexsort((found_keys, -found), axis=1)[:, :limit]
            found, found_keys = np.take_along_axis(found, top, 1), np.take_along_axis(found_keys, top, 1)
    return found_keys, found / scale


def search(vectors: DataFrame, queries: DataFrame, limit: int = 5, key: str = "point_id", query_key: str = "query_id", places: int = 5) -> DataFrame:
    """(query_key, rank, key, score): exact cosine top-k of vectors(key, embedding) for queries(query_key, embedding).

    Blocks of queries are broadcast; every batch of vectors keeps its best rows for each query, and only those are shuffled.
    Scores are rounded before they are compared, ties go to the lesser key. Null and zero vectors, and those of another length than the query's, are no hits.
    """
    context = vectors.sparkSession.sparkContext
    found = None
    block: list[tuple] = []

    def scan(ids: list, matrix: np.ndarray) -> DataFrame:
        shared = context.broadcast((np.array(ids, np.int64), matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for b in batches:
                x, kept = _rows(b.column(1), q.shape[1])
                keys = b.column(0).to_numpy(zero_copy_only=False)[kept].astype(np.int64)
                norm = np.linalg.norm(x, axis=1)
                keys, x = keys[norm > 0], x[norm > 0] / norm[norm > 0, None]
                if not len(keys):
                    continue
                got, score = best(q, keys, x, limit, places)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, got.shape[1])), pa.array(got.ravel()), pa.array(score.ravel() + 0.0)], names=[query_key, key, "score"])

        return vectors.select(key, "embedding").where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).mapInArrow(run, f"{query_key} bigint, {key} bigint, score double")

    def flush(found: DataFrame | None) -> DataFrame:
        for width in sorted({len(v) for _, v in block}):
            rows = [(i, v) for i, v in block if len(v) == width]
            m = np.array([v for _, v in rows], np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            part = scan([i for i, _ in rows], np.divide(m, n, out=np.zeros_like(m), where=n > 0))
            found = part if found is None else found.unionByName(part)
        return found

    held = 0
    for r in queries.select(query_key, "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).toLocalIterator():
        block.append((r[0], r[1]))
        held += 8 * len(r[1])
        if held >= QUERY_BYTES:
            found, block, held = flush(found), [], 0
    if block:
        found = flush(found)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"{query_key} bigint, rank int, {key} bigint, score double")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(query_key, "rank", key, "score")
