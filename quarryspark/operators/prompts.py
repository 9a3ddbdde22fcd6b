"""Texts made of hits: prompts, listings, and evidence without repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import location


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, prompt): numbered excerpts in order of rank, then the question. hits hold query_id, rank and the columns of a chunk; a top-k bounds them."""
    place = location(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol_type"), F.col("symbol_name"))
    excerpt = F.concat(F.lit("--- Excerpt "), F.col("rank").cast("string"), F.lit(": "), place, F.lit(" ---\n"), F.col("content"))
    joined = hits.select("query_id", "rank", excerpt.alias("text")).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s.text), "\n\n").alias("excerpts"))
    body = F.concat(F.lit("Code excerpts from the repository:\n\n"), F.coalesce("excerpts", F.lit("(no excerpts found)")), F.lit("\n\nQuestion: "), F.col("query"))
    return questions.join(joined, "query_id", "left").select("query_id", body.alias("prompt"))


def listing(hits: DataFrame) -> DataFrame:
    """(query_id, listing): one line for each hit, its place only."""
    place = location(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol_type"), F.col("symbol_name"))
    lines = hits.select("query_id", "rank", place.alias("text")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("l"))
    return lines.select("query_id", F.array_join(F.transform("l", lambda s: s.text), "\n").alias("listing"))


def formatted(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, text): the hits of a tool call as a model reads them, without numbers; a query without hits says so."""
    place = location(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol_type"), F.col("symbol_name"))
    block = F.concat(F.lit("--- "), place, F.lit(" ---\n"), F.col("content"))
    joined = hits.select("query_id", "rank", block.alias("text")).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s.text), "\n\n").alias("text"))
    return questions.select("query_id").distinct().join(joined, "query_id", "left").select("query_id", F.coalesce("text", F.lit("No results.")).alias("text"))


def first_evidence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order: an aggregate, so a repeated key is reduced before it is shuffled."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")
