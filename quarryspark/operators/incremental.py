"""Snapshot differences and what has to be indexed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["owner", "name", "path"]


def snapshot(files: DataFrame) -> DataFrame:
    """(owner, name, path, sha1). Files without a text are not part of a snapshot. Only hashes leave the scan."""
    return files.where("content IS NOT NULL").select(*KEYS, F.sha1("content").alias("sha1")).groupBy(*KEYS).agg(F.max("sha1").alias("sha1"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(owner, name, path, change): added, modified, deleted or unchanged."""
    a, b = old.select(*KEYS, F.col("sha1").alias("before")), new.select(*KEYS, F.col("sha1").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") != F.col("after"), "modified").otherwise("unchanged")
    return a.join(b, KEYS, "full_outer").select(*KEYS, change.alias("change"))


def summary(diff: DataFrame) -> DataFrame:
    kinds = ["added", "modified", "deleted", "unchanged"]
    return diff.groupBy("owner", "name").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def to_index(diff: DataFrame, files: DataFrame) -> DataFrame:
    """The files that are chunked and embedded again."""
    return files.join(diff.where(F.col("change").isin("added", "modified")).select(*KEYS), KEYS, "left_semi")


def without_stale(chunks: DataFrame, diff: DataFrame) -> DataFrame:
    """Stored chunks less those of modified and deleted files."""
    stale = diff.where(F.col("change").isin("modified", "deleted")).select("owner", "name", F.col("path").alias("file_path"))
    return chunks.join(stale, ["owner", "name", "file_path"], "left_anti")


def upsert(chunks: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    return without_stale(chunks, diff).unionByName(fresh).dropDuplicates(["owner", "name", "chunk_id"])
