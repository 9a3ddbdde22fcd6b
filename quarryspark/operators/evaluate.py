"""Ranking and refusal metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_files(hits: DataFrame) -> DataFrame:
    """(query_id, file_rank, file_path): files in the order of their first hit; hits hold query_id, rank, file_path."""
    first = hits.groupBy("query_id", "file_path").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", "file_path")
    return first.select("query_id", "file_path", F.row_number().over(order).alias("file_rank"))


def first_correct(files: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, category, correct): rank of the first expected file, null if none is ranked."""
    expected = questions.select("query_id", F.explode("expected_files").alias("file_path")).distinct()
    hit = files.join(expected, ["query_id", "file_path"]).groupBy("query_id").agg(F.min("file_rank").alias("correct"))
    return questions.select("query_id", "category").distinct().join(hit, "query_id", "left")


def ranking_metrics(correct: DataFrame, *groups: str) -> DataFrame:
    at = lambda k: F.round(F.avg(F.when(F.col("correct") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}")
    return correct.groupBy(*groups).agg(F.count("*").alias("questions"), at(1), at(3), at(5), F.round(F.avg(F.coalesce(1 / F.col("correct"), F.lit(0.0))), 6).alias("mrr"))


def misses(correct: DataFrame, files: DataFrame, top: int = 3) -> DataFrame:
    """Questions whose first file is no expected one, with their best files."""
    best = files.where(F.col("file_rank") <= top).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("file_rank", "file_path"))), lambda s: s.file_path).alias("files"))
    return correct.where("correct IS NULL OR correct <> 1").join(best, "query_id", "left")


def best_variant(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max_by("variant", F.struct("mrr", "variant")).alias("variant"), F.max("mrr").alias("mrr"))


def side_by_side(metrics: DataFrame, variants: list[str], value: str = "recall_at_1") -> DataFrame:
    """(category, one column for each variant) of metrics(variant, category, value); null where a variant has no such category."""
    return metrics.groupBy("category").pivot("variant", variants).agg(F.first(value))


def refusal_rates(answers: DataFrame) -> DataFrame:
    """Per category and, as a null category with level 1, over all: answers(category, refused boolean)."""
    return answers.rollup("category").agg(F.grouping("category").cast("int").alias("level"), F.count("*").alias("questions"), F.count_if(F.col("refused")).alias("refused")).withColumn("rate", F.round(F.col("refused") / F.col("questions"), 6))
