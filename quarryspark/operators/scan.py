"""File selection: the first rule that holds gives the reason why a file is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EXTENSIONS, IGNORED_DIRECTORIES, LIMITS, ROOT_DIRECTORY, SECRET_PATTERNS, SKIP_BINARY, SKIP_EXTENSION, SKIP_IGNORED, SKIP_SECRET, SKIP_SIZE, SKIP_UNREADABLE
from ..functions.text import file_extension, top_directory


def in_ignored_directory(path: Column) -> Column:
    """Whether a directory above the file, not the file itself, is an ignored one."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRECTORIES)))


def contains_secret(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in SECRET_PATTERNS))


def decode_text(content: Column) -> Column:
    """Text of a binary column; null if it holds a NUL byte or is not valid UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.when(F.instr(text, "\0") == 0, text)


def skip_reason(path: Column, size: Column, text: Column, max_bytes: int = LIMITS.max_file_bytes) -> Column:
    """Native expressions only: later rules, which read the text, are evaluated just where the earlier ones pass."""
    return (
        F.when(in_ignored_directory(path), SKIP_IGNORED)
        .when(~file_extension(path).isin(EXTENSIONS), SKIP_EXTENSION)
        .when(size.isNull(), SKIP_UNREADABLE)
        .when(size > max_bytes, SKIP_SIZE)
        .when(text.isNull() | (F.instr(text, "\0") > 0), SKIP_BINARY)
        .when(contains_secret(text), SKIP_SECRET)
    )


def selection(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """Scanned files with extension and skip_reason, null for selected ones.

    The rules that need no text run first, on narrow rows; the text is reduced to two flags before the join, so no content is shuffled.
    """
    flags = texts.select("file_id", (F.col("content").isNull() | (F.instr("content", "\0") > 0)).alias("bad"), F.coalesce(contains_secret(F.col("content")), F.lit(False)).alias("secret"))
    early = (
        F.when(in_ignored_directory(F.col("path")), SKIP_IGNORED)
        .when(~file_extension(F.col("path")).isin(EXTENSIONS), SKIP_EXTENSION)
        .when(F.col("size_bytes").isNull(), SKIP_UNREADABLE)
        .when(F.col("size_bytes") > LIMITS.max_file_bytes, SKIP_SIZE)
    )
    rows = scanned.select("file_id", "owner", "name", "path", file_extension(F.col("path")).alias("extension"), "size_bytes", "lines", early.alias("early"))
    late = F.when(F.coalesce("bad", F.lit(True)), SKIP_BINARY).when(F.col("secret"), SKIP_SECRET)
    return rows.join(flags, "file_id", "left").select(*[c for c in rows.columns if c != "early"], F.coalesce("early", late).alias("skip_reason"))


def count_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Counts by a key without nulls, most frequent first, then by key."""
    return rows.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def by_extension(selected: DataFrame) -> DataFrame:
    return count_by(selected, F.col("extension"), "extension")


def by_top_directory(selected: DataFrame) -> DataFrame:
    return count_by(selected, top_directory(F.col("path"), ROOT_DIRECTORY), "directory")


def largest_files(selected: DataFrame, limit: int = 5) -> DataFrame:
    return selected.orderBy(F.desc_nulls_last("lines"), "path", "file_id").limit(limit)


def totals(rows: DataFrame) -> DataFrame:
    chosen = F.col("skip_reason").isNull()
    return rows.agg(F.count("*").alias("total_tracked"), F.count_if(chosen).alias("selected"), F.count_if(~chosen).alias("skipped"), F.coalesce(F.sum(F.when(chosen, F.col("lines").cast("bigint"))), F.lit(0)).alias("total_lines"))


def listing(rows: DataFrame, limit: int, *order: str) -> tuple[DataFrame, bool]:
    """The first rows and whether more follow; aggregates are never computed on a listing."""
    cut = rows.orderBy(*order).limit(limit + 1)
    return cut.limit(limit), cut.count() > limit
