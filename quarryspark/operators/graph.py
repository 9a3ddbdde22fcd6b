"""The import graph of a repository's files."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SCRIPT_SUFFIXES
from ..functions.text import file_extension

# fixed value: a relative import of a script
SCRIPT_IMPORT = r"""(?:from\s+|import\s*\(\s*)['"](\.[^'"]+)['"]"""
REPO = ["owner", "name"]


def python_imports_of(text: str | None) -> list[tuple[int, str | None]]:
    """(level, module) of every import, level 0 for absolute ones; nothing for what does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found: set[tuple[int, str | None]] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found.update((0, a.name) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            found.add((node.level, node.module))
    return sorted(found, key=lambda x: (x[0], x[1] or ""))


def python_imports(files: DataFrame) -> DataFrame:
    """(owner, name, path, level, module)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(o, n, p, *x) for o, n, p, t in zip(*(b.column(c).to_pylist() for c in ("owner", "name", "path", "content"))) for x in python_imports_of(t)]
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["owner", "name", "path", "level", "module"])

    rows = files.where(file_extension(F.col("path")) == ".py").select("owner", "name", "path", "content")
    return rows.mapInArrow(run, "owner string, name string, path string, level int, module string")


def module_key(path):
    """Path of a module without .py or /__init__.py; null for an __init__.py at the root."""
    key = F.regexp_replace(path, r"(?:/__init__)?\.py$", "")
    return F.when(path != "__init__.py", key)


def suffix_index(files: DataFrame) -> DataFrame:
    """(owner, name, key, path): every suffix of a module's path names it; the module with the fewest parts wins, then the lesser path."""
    mods = files.where(F.col("path").endswith(".py")).select(*REPO, "path", F.split(module_key(F.col("path")), "/").alias("parts")).where("parts IS NOT NULL")
    n = F.size("parts")
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("parts", i, n), "/"))
    return mods.select(*REPO, "path", n.alias("n"), F.explode(suffixes).alias("key")).groupBy(*REPO, "key").agg(F.min(F.struct("n", "path")).alias("m")).select(*REPO, "key", F.col("m.path").alias("path"))


def relative_target(path, level, module):
    """Key of a relative import: up level - 1 directories, then the module; null above the root."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    left = F.size(folders) - (level - 1)
    base = F.slice(folders, 1, F.greatest(left, F.lit(0)))
    extra = F.when(module.isNull(), F.array().cast("array<string>")).otherwise(F.split(module, r"\."))
    key = F.array_join(F.concat(base, extra), "/")
    return F.when((left >= 0) & (key != ""), key)


def python_edges(files: DataFrame) -> DataFrame:
    imports = python_imports(files)
    key = F.when(F.col("level") > 0, relative_target(F.col("path"), F.col("level"), F.col("module"))).otherwise(F.replace(F.col("module"), F.lit("."), F.lit("/")))
    wanted = imports.select(*REPO, F.col("path").alias("source"), key.alias("key")).where("key IS NOT NULL")
    hit = wanted.join(suffix_index(files).withColumnRenamed("path", "target"), [*REPO, "key"])
    return hit.where("source <> target").select(*REPO, "source", "target").distinct()


def normal_path(path):
    """A path without . and .. parts; those above the root are dropped."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def script_edges(files: DataFrame) -> DataFrame:
    """Relative script imports resolved to the first existing file of the endings they may stand for."""
    rows = files.where(file_extension(F.col("path")).isin(".js", ".ts", ".tsx"))
    raw = rows.select(*REPO, F.col("path").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(SCRIPT_IMPORT), F.lit(1)))).alias("raw"))
    folder = F.regexp_extract("source", r"^(.*/)?[^/]*$", 1)
    base = raw.select(*REPO, "source", "raw", normal_path(F.concat(folder, F.col("raw"))).alias("base"))
    tries = base.select("*", F.posexplode(F.array(*map(F.lit, SCRIPT_SUFFIXES))).alias("at", "suffix")).withColumn("target", F.concat("base", "suffix"))
    known = files.select(*REPO, F.col("path").alias("target")).distinct()
    first = tries.join(known, [*REPO, "target"]).groupBy(*REPO, "source", "raw").agg(F.min_by("target", "at").alias("target"))
    return first.where("source <> target").select(*REPO, "source", "target").distinct()


def dependency_edges(files: DataFrame) -> DataFrame:
    return python_edges(files).unionByName(script_edges(files))


def dependency_nodes(files: DataFrame) -> DataFrame:
    return files.select(*REPO, "path").distinct()
