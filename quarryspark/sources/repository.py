"""Files of a repository: a local git checkout, or a directory tree read by Spark."""

from __future__ import annotations

import os
import shutil
import subprocess
import uuid
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.addresses import check_reference, clone_failure
from ..functions.text import count_lines
from ..operators.scan import decode_text

UNKNOWN_COMMIT = "bilinmiyor"


def _git(path: Path, *args: str, seconds: int = 60) -> str:
    try:
        return subprocess.run(["git", "-C", str(path), *args], capture_output=True, text=True, timeout=seconds, check=True).stdout
    except (OSError, subprocess.SubprocessError) as e:
        raise EngineError(f"git {args[0]} failed", 502) from e


def head_commit(path: str | Path) -> str:
    try:
        return _git(Path(path), "rev-parse", "HEAD").strip() or UNKNOWN_COMMIT
    except EngineError:
        return UNKNOWN_COMMIT


def clone(address: str, root: str | Path, owner: str, name: str, seconds: int = 300) -> Path:
    """A shallow checkout of an address below root; one that is there is left as it is. A failed clone leaves nothing behind."""
    check_reference(owner, name)
    target = Path(root) / owner / name
    if (target / ".git").exists():
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{name}.{uuid.uuid4().hex}")
    try:
        done = subprocess.run(["git", "clone", "--depth", "1", "--", address, str(part)], capture_output=True, text=True, timeout=seconds, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"})
        if done.returncode:
            raise EngineError(*clone_failure(done.stderr))
        part.rename(target)
    except subprocess.TimeoutExpired as e:
        raise EngineError("cloning took too long", 504) from e
    finally:
        shutil.rmtree(part, ignore_errors=True)
    return target


def pull_latest(path: str | Path) -> str:
    _git(Path(path), "fetch", "--depth", "1", "origin", seconds=120)
    _git(Path(path), "reset", "--hard", "FETCH_HEAD")
    return head_commit(path)


def tracked_files(path: str | Path) -> list[str]:
    return [f for f in _git(Path(path), "ls-files", "-z").split("\0") if f]


def repository_path(root: str | Path, owner: str, name: str) -> Path:
    p = Path(root) / owner / name
    if not p.is_dir():
        raise EngineError("no such repository", 404)
    return p


def confined(relative: str) -> str:
    """A relative path with . and .. resolved; one that leads out of the repository is an error."""
    parts: list[str] = []
    for p in PurePosixPath(relative.replace("\\", "/")).parts:
        if p == "..":
            if not parts:
                raise EngineError("path outside the repository", 400)
            parts.pop()
        elif p not in (".", "/"):
            parts.append(p)
        elif p == "/":
            raise EngineError("path outside the repository", 400)
    return "/".join(parts)


def read_checkout(spark: SparkSession, path: str | Path, owner: str, name: str) -> DataFrame:
    """Tracked files of a checkout: owner, name, path, size_bytes, lines, content (null if it is no text).

    The listing is git's, the contents are read by the executors; the folder must be shared on a cluster.
    """
    base = Path(path).resolve()
    listed = spark.createDataFrame([(f,) for f in tracked_files(base)], "path string")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(str(base))
    rel = F.expr("regexp_replace(path, '^file:/+', '/')")
    rows = read.select(F.substring(rel, len(str(base)) + 2, 100_000).alias("path"), F.col("length").alias("size_bytes"), decode_text(F.col("content")).alias("content"))
    return rows.join(listed, "path", "left_semi").select(F.lit(owner).alias("owner"), F.lit(name).alias("name"), "path", "size_bytes", count_lines(F.col("content")).alias("lines"), "content")
