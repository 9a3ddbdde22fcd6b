"""Search indexes that are written once and read by every search: postings, document frequencies, vectors.

Terms are 64-bit hashes. Postings lie in folders by their term, each written by a few tasks, so the postings of a frequent term are spread; within a file they are sorted by
term, so a search reads the row groups of its terms. An index belongs to one state of its chunks: the engine writes one per version, and
``table_index`` one per content of a stored table, kept for the session.
"""

from __future__ import annotations

import atexit
import json
import shutil
import uuid
from collections import OrderedDict
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators import bm25, vector
from . import folders
from .checkpoints import shared_folder

#: Postings in one folder, about; tasks that write one folder, at least; postings that a task sorts, about.
PART_ROWS, WRITERS, TASK_ROWS = 20_000_000, 4, 1_000_000
#: Indexes of stored tables kept in a session; the one used longest ago is deleted first.
KEPT = 4
_POSTINGS = "term bigint, point_id bigint, tf int, dl int, part int"


class SearchIndex:
    """An index in a folder. One of a stored table is written part by part, each at the first search that reads it; one of the engine is there whole."""

    def __init__(self, spark: SparkSession, path: str, chunks: Callable[[], DataFrame] | None = None, embed: Callable[..., DataFrame] = vector.embed) -> None:
        self.spark, self.path, self._chunks, self._embed = spark, path, chunks, embed
        self._stats: dict | None = None
        self._vectors = chunks is None

    @property
    def stats(self) -> dict:
        """parts, n, avgdl and mean of the postings."""
        if self._stats is None:
            text = folders.read_text(self.spark, f"{self.path}/postings.json")
            if text is None:
                if self._chunks is None:
                    raise EngineError("there is no index", 404)
                write_postings(self._chunks(), self.path)
                text = folders.read_text(self.spark, f"{self.path}/postings.json")
            self._stats = json.loads(text)
        return self._stats

    def postings(self) -> DataFrame:
        # an index of no text has no file to take the schema from
        parts = self.stats["parts"]
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")
        return rows.where(F.col("part") < parts)

    def terms(self) -> DataFrame:
        self.stats  # noqa: B018
        return self.spark.read.parquet(f"{self.path}/terms")

    def vectors(self) -> DataFrame:
        if not self._vectors:
            write_vectors(self._chunks(), self.path, self._embed)
            self._vectors = True
        return self.spark.read.parquet(f"{self.path}/vectors")

    def keyword(self, queries: DataFrame, limit: int) -> DataFrame:
        s = self.stats
        return bm25.search_postings(self.postings(), self.terms(), (s["n"], s["avgdl"], s["mean"]), queries, limit, s["parts"])

    def semantic(self, queries: DataFrame, limit: int, embed: Callable[..., DataFrame] | None = None) -> DataFrame:
        return vector.search(self.vectors(), (embed or self._embed)(queries, "query_id", "query"), limit)


def write_postings(chunks: DataFrame, path: str) -> None:
    """Postings of chunks(point_id, file_path, content, symbol_name), their document frequencies and statistics, in one shuffle of the postings."""
    spark = chunks.sparkSession
    # a posting for every twelve characters, about; only the number of folders follows from this
    expected = int(chunks.agg(F.sum(F.length("content"))).first()[0] or 0) // 12
    parts = max(1, expected // PART_ROWS)
    rows = bm25.posting_rows(bm25.tokenized(chunks))
    # the rows of the documents themselves have a folder of their own
    part = F.when(F.col("term").isNull(), F.lit(parts)).otherwise(F.pmod(F.col("term"), F.lit(parts))).cast("int")
    # each folder's postings go to so many tasks by their document, so a frequent term is spread; one id, one task
    writers = max(WRITERS, -(-max(int(spark.conf.get("spark.sql.shuffle.partitions")), expected // TASK_ROWS) // parts))
    spread = rows.withColumn("part", part).repartitionById((parts + 1) * writers, F.col("part") * writers + F.pmod(F.xxhash64("point_id"), F.lit(writers)).cast("int"))
    spread.sortWithinPartitions("part", "term").write.partitionBy("part").option("parquet.block.size", 16_000_000).parquet(f"{path}/postings")
    stored = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    stored.where(F.col("part") < parts).groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    sums = stored.where(F.col("part") == parts).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    mean = spark.read.parquet(f"{path}/terms").agg(F.avg(bm25.raw_idf(F.lit(sums.n), F.col("df"))).alias("mean")).first().mean
    folders.write_text(spark, f"{path}/postings.json", json.dumps({"parts": parts, "n": sums.n, "avgdl": sums.avgdl or 0.0, "mean": mean or 0.0}))


def write_vectors(chunks: DataFrame, path: str, embed: Callable[..., DataFrame] = vector.embed) -> None:
    """(point_id, embedding); chunks with an embedding column keep it."""
    own = chunks.select("point_id", "embedding").where("embedding IS NOT NULL") if "embedding" in chunks.columns else embed(chunks, "point_id", "content")
    own.write.parquet(f"{path}/vectors")


def write_index(chunks: DataFrame, path: str, embed: Callable[..., DataFrame] = vector.embed) -> SearchIndex:
    write_postings(chunks, path)
    write_vectors(chunks, path, embed)
    return SearchIndex(chunks.sparkSession, path, embed=embed)


def open_index(spark: SparkSession, path: str) -> SearchIndex | None:
    return SearchIndex(spark, path) if folders.exists(spark, f"{path}/postings.json") else None


_TABLES: OrderedDict[tuple, SearchIndex] = OrderedDict()


def table_index(spark: SparkSession, source: str, chunks: Callable[[], DataFrame]) -> SearchIndex:
    """The index of a stored table, built at its first search and again once the table's files change."""
    key = (spark.sparkContext.applicationId, source, folders.fingerprint(spark, source))
    if key not in _TABLES:
        _TABLES[key] = SearchIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", chunks)
        while len(_TABLES) > KEPT:
            _drop(_TABLES.popitem(last=False)[1])
    _TABLES.move_to_end(key)
    return _TABLES[key]


def _drop(index: SearchIndex) -> None:
    """Deletes an index; on a local path also where the session has ended before."""
    where = urlparse(index.path)
    if where.scheme in ("", "file"):
        shutil.rmtree(where.path, ignore_errors=True)
    elif index.spark.sparkContext._jsc is not None:
        folders.delete(index.spark, index.path)


@atexit.register
def _clear() -> None:
    while _TABLES:
        _drop(_TABLES.popitem()[1])
