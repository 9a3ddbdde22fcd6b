"""Versioned index store: Parquet per repository and version, a pointer per repository to its current version.

A write makes a new version directory with chunks, snapshot and search index and then moves the pointer, so readers never see half an index and every cache that holds the
version in its key is invalidated by the move. The root may be any address that the executors reach; old versions are kept until ``prune``.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from . import folders
from .postings import SearchIndex, open_index, write_index


class IndexStore:
    """On a cluster, root is a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root = spark, str(root).rstrip("/")
        self._open: dict[str, SearchIndex] = {}

    def _pointer(self, owner: str, name: str) -> str:
        return f"{self.root}/pointers/{owner}/{name}.json"

    def exists(self, owner: str, name: str) -> bool:
        return folders.exists(self.spark, self._pointer(owner, name))

    def describe(self, owner: str, name: str) -> dict:
        text = folders.read_text(self.spark, self._pointer(owner, name))
        if text is None:
            raise EngineError("repository is not indexed", 404)
        return json.loads(text)

    def version(self, owner: str, name: str) -> str:
        return self.describe(owner, name)["version"]

    def write(self, owner: str, name: str, chunks: DataFrame, state: DataFrame, commit: str, vectors: DataFrame | None = None) -> dict:
        """chunks with their vectors and the snapshot they were made from. chunk_id is the key: a later row of one is dropped.

        vectors(point_id, embedding), if given apart, must hold as many rows as there are chunks, a null embedding where a text has none.
        """
        version = uuid.uuid4().hex
        base = f"{self.root}/versions/{owner}/{name}/{version}"
        if vectors is not None:
            chunks.drop("embedding").dropDuplicates(["owner", "name", "chunk_id"]).write.parquet(f"{base}/bare")
            vectors.dropDuplicates(["point_id"]).write.parquet(f"{base}/given")
            bare, given = self.spark.read.parquet(f"{base}/bare"), self.spark.read.parquet(f"{base}/given")
            if bare.count() != given.count() or bare.join(given, "point_id", "left_anti").count():
                folders.delete(self.spark, base)
                raise EngineError("as many vectors as chunks are needed", 500)
            chunks = bare.join(given, "point_id")
        chunks.dropDuplicates(["owner", "name", "chunk_id"]).write.parquet(f"{base}/chunks")
        for part in ("bare", "given"):
            folders.delete(self.spark, f"{base}/{part}")
        state.write.parquet(f"{base}/state")
        stored = self.spark.read.parquet(f"{base}/chunks")
        write_index(stored, f"{base}/index")
        described = {"version": version, "commit": commit, "chunks": stored.count(), "path": base}
        folders.write_text(self.spark, self._pointer(owner, name), json.dumps(described))
        return described

    def chunks(self, owner: str, name: str, vectors: bool = True) -> DataFrame:
        df = self.spark.read.parquet(f"{self.describe(owner, name)['path']}/chunks")
        return df if vectors else df.drop("embedding")

    def search_index(self, owner: str, name: str) -> SearchIndex:
        """The current version's postings and vectors; opened once per version."""
        path = self.describe(owner, name)["path"]
        if path not in self._open:
            self._open = {k: v for k, v in self._open.items() if not k.startswith(f"{self.root}/versions/{owner}/{name}/")}
            self._open[path] = open_index(self.spark, f"{path}/index")
        return self._open[path]

    def state(self, owner: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.describe(owner, name)['path']}/state")

    def count(self, owner: str, name: str) -> int:
        return self.describe(owner, name)["chunks"] if self.exists(owner, name) else 0

    def delete_file(self, owner: str, name: str, path: str) -> None:
        if self.exists(owner, name):
            d = self.describe(owner, name)
            self.write(owner, name, self.chunks(owner, name).where(F.col("file_path") != path), self.state(owner, name).where(F.col("path") != path), d["commit"])

    def reset(self, owner: str, name: str) -> None:
        """Takes the index away with all its versions."""
        folders.delete(self.spark, self._pointer(owner, name))
        folders.delete(self.spark, f"{self.root}/versions/{owner}/{name}")
        self._open = {k: v for k, v in self._open.items() if not k.startswith(f"{self.root}/versions/{owner}/{name}/")}

    def prune(self, owner: str, name: str, keep: list[str]) -> None:
        """Deletes the named versions' elders: all versions but the current one and those to keep."""
        current = self.version(owner, name)
        for version in folders.names(self.spark, f"{self.root}/versions/{owner}/{name}"):
            if version != current and version not in keep:
                folders.delete(self.spark, f"{self.root}/versions/{owner}/{name}/{version}")
