"""Reciprocal rank fusion of two ranked lists, and lexical reranking of what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import code_tokens, rerank_text


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int = 5, k: int = LIMITS.rrf_k, missing: int = LIMITS.pool + 1) -> DataFrame:
    """(query_id, rank, point_id, score, vector_rank, keyword_rank) from two lists of (query_id, rank, point_id).

    Ordered by score, then by the better rank, then by point_id; either list may be empty.
    """
    v = vector_hits.select("query_id", "point_id", F.col("rank").alias("vector_rank"))
    w = keyword_hits.select("query_id", "point_id", F.col("rank").alias("keyword_rank"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = v.join(w, ["query_id", "point_id"], "full_outer").withColumn("score", F.round(part("vector_rank") + part("keyword_rank"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce(F.least("vector_rank", "keyword_rank"), F.lit(missing)), "point_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "point_id", "score", "vector_rank", "keyword_rank")


def lexical_score(query, document):
    """Share of the query's distinct tokens that the document holds: the default scorer, replaced by a model's pandas UDF where there is one."""
    q = F.array_distinct(code_tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, code_tokens(document))) / F.size(q), 6))


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int = 5, scorer=lexical_score) -> DataFrame:
    """Hits with rerank_score and the new rank. Only the pool is joined to its texts, so the scorer runs on few rows.

    Hits are read twice: pass a settled pool, or the searches behind it run twice.
    """
    pool = hits.select("query_id", "point_id", "score", *[c for c in ("vector_rank", "keyword_rank") if c in hits.columns])
    texts = chunks.join(pool.select("point_id").distinct(), "point_id", "left_semi").select("point_id", rerank_text(F.col("file_path"), F.col("symbol_name"), F.col("content")).alias("document"))
    scored = pool.join(queries.select("query_id", "query"), "query_id").join(texts, "point_id").withColumn("rerank_score", scorer(F.col("query"), F.col("document"))).drop("query", "document")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "point_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
