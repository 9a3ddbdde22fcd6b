"""Source files that do not parse, by language-specific lexers with a pushdown stack.

The language is the one the path's ending names. Markdown, unknown endings, null and empty contents are always valid. What the Python lexer
finds is confirmed by the interpreter's parser. Repeated rows of a file count once; should contents of one file differ, a file is
flagged if any of them is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import brace_lexer, python_lexer
from .common import require

LANGUAGES = {".py": "python", ".js": "js", ".ts": "ts", ".tsx": "tsx", ".java": "java"}


def language_of(path: str | None) -> str | None:
    name = (path or "").rsplit("/", 1)[-1]
    return LANGUAGES.get(name[name.rfind(".") :].lower()) if "." in name else None


def syntax_error(path: str | None, text: str | None) -> str | None:
    """conflict, literal, delimiter, unclosed, premature, header, indent, block, adjacent, annotation, markup, declaration, top or other."""
    language = language_of(path)
    if language is None or not text or not text.strip():
        return None
    if language == "python":
        kind = python_lexer.find_error(text)
        return kind if kind and python_lexer.confirmed(text) else None
    return brace_lexer.find_error(text, language)


def checked(files: DataFrame) -> DataFrame:
    """(file_id, owner, name, language, error) for every row of files in a known language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_pylist()
            errors = [syntax_error(p, t) for p, t in zip(paths, b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("owner"), b.column("name"), pa.array([language_of(p) for p in paths], pa.string()), pa.array(errors, pa.string())], names=["file_id", "owner", "name", "language", "error"])

    # contents of other endings are never read into Python
    known = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*LANGUAGES)
    rows = require(files, "file_id", "owner", "name", "path", "content").where(F.col("file_id").isNotNull() & known)
    return rows.mapInArrow(run, "file_id bigint, owner string, name string, language string, error string")


def broken_files(files: DataFrame) -> DataFrame:
    """(file_id, error), one row per file with a syntax error."""
    return checked(files).where("error IS NOT NULL").groupBy("file_id").agg(F.min("error").alias("error"))


def error_rates(files: DataFrame) -> DataFrame:
    """Per repository and language, with the totals of either and of all as nulls: files, broken, rate."""
    per = checked(files).groupBy("file_id").agg(F.max(F.struct("owner", "name", "language")).alias("f"), F.max(F.col("error").isNotNull().cast("int")).alias("bad"))
    base = per.select(F.concat_ws("/", F.coalesce("f.owner", F.lit("")), F.coalesce("f.name", F.lit(""))).alias("repository"), "f.language", "bad")
    return base.cube("repository", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("broken"), F.round(F.avg("bad"), 6).alias("rate"))
