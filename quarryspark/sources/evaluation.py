"""Labelled question sets and results as JSON files."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from . import folders

_QUESTIONS = "array<struct<id:string,category:string,question:string,expected_files:array<string>>>"


def load_questions(spark: SparkSession, path: str) -> tuple[dict[str, Any], DataFrame]:
    """(repository, questions(query_id, id, category, query, expected_files)) of {repository, questions}; query_id counts from 0 in order of the file.

    The file is one document that people write by hand, so it is read whole.
    """
    text = folders.read_text(spark, path)
    if text is None:
        raise EngineError("no such question set", 404)
    try:
        repository = json.loads(text)["repository"]
    except (ValueError, KeyError, TypeError) as e:
        raise EngineError("not a question set", 422) from e
    one = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", f"struct<questions:{_QUESTIONS}>").alias("d"))
    rows = one.select(F.posexplode("d.questions").alias("query_id", "q"))
    return repository, rows.select(F.col("query_id").cast("bigint"), "q.id", "q.category", F.col("q.question").alias("query"), "q.expected_files")


def save_results(spark: SparkSession, path: str, **parts: Any) -> None:
    """Results as one readable JSON file; rows become objects."""
    plain = lambda v: v.asDict(recursive=True) if hasattr(v, "asDict") else str(v)
    as_objects = lambda v: [as_objects(x) for x in v] if isinstance(v, list) else plain(v) if hasattr(v, "asDict") else v
    folders.write_text(spark, path, json.dumps({k: as_objects(v) for k, v in parts.items()}, indent=2, ensure_ascii=False, default=plain))
