"""The stored tables, with repeated rows folded and wrong columns put right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate with a map-side combine, so a key repeated without bound costs one row a task."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*[F.col(c) for c in order], F.xxhash64(*others)))
    return rows.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: the last scan."""
    return latest(table(spark, sf_dir, "scanned_files"), ["file_id"], ["scanned_at", "arrived_at"])


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: file_id, owner, name, path, content."""
    return table(spark, sf_dir, "files_raw").select("file_id", "owner", "name", "path", "content").dropDuplicates(["file_id"])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per point; the line range is read from chunk_id, which is right where the columns are not."""
    rows = table(spark, sf_dir, "chunks").dropDuplicates(["point_id"])
    at = lambda i: F.regexp_extract("chunk_id", r":(\d+)-(\d+)$", i)
    fixed = lambda i, c: F.coalesce(F.when(at(i) != "", at(i).cast("int")), F.col(c))
    return rows.withColumns({"start_line": fixed(1, "start_line"), "end_line": fixed(2, "end_line")})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hallucination_result").dropDuplicates(["id"])


def eval_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches: items whose id is divisible by 20."""
    return all_questions(spark, sf_dir).where("query_id % 20 = 0")


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled question; there are 240 at any size."""
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), "category", "expected_files")
