"""Chunks along declarations, falling back to line windows.

A declaration of at most ``max_symbol_lines`` lines is one chunk. A longer one is cut at its inner declarations, down to
``max_split_depth`` levels; what lies between them keeps the outer symbol. What has no inner declaration is cut into line windows.
Statements between declarations gather into module ranges. Blank ranges are dropped. The work is local to a file: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS, Limits
from .outline import Declaration, outline

_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
Piece = tuple[int, int, str | None, str | None]


def windows(start: int, end: int, limits: Limits = LIMITS) -> list[tuple[int, int]]:
    step = limits.window_lines - limits.window_overlap
    out, at = [], start
    while True:
        stop = min(at + limits.window_lines - 1, end)
        out.append((at, stop))
        if stop >= end:
            return out
        at += step


def _range(start: int, end: int, kind: str | None, name: str | None, limits: Limits) -> list[Piece]:
    whole = [(start, end)] if end - start + 1 <= limits.max_symbol_lines else windows(start, end, limits)
    return [(a, b, kind, name) for a, b in whole]


def _symbol(d: Declaration, limits: Limits, depth: int = 0) -> list[Piece]:
    if d.end - d.start + 1 <= limits.max_symbol_lines:
        return [(d.start, d.end, d.kind, d.name)]
    inner = [x for x in d.inner if x.kind]
    if not inner or depth >= limits.max_split_depth:
        return [(a, b, d.kind, d.name) for a, b in windows(d.start, d.end, limits)]
    out: list[Piece] = []
    at = d.start
    for x in inner:
        if x.start > at:
            out += _range(at, x.start - 1, d.kind, d.name, limits)
        out += _symbol(x, limits, depth + 1)
        at = x.end + 1
    return out + (_range(at, d.end, d.kind, d.name, limits) if at <= d.end else [])


def pieces(extension: str, text: str, limits: Limits = LIMITS) -> list[tuple[int, int, str, str | None, str | None]]:
    """(start_line, end_line, content, symbol_type, symbol_name), sorted by range."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    if not lines:
        return []
    nodes = outline(extension, "\n".join(lines))
    out: list[Piece] = []
    open_: list[int] | None = None
    for d in nodes or []:
        if d.kind is None:
            open_ = [open_[0], max(open_[1], d.end)] if open_ else [d.start, d.end]
            continue
        if open_:
            out += [(a, b, "module", None) for a, b in windows(*open_, limits)]
            open_ = None
        out += _symbol(d, limits)
    if open_:
        out += [(a, b, "module", None) for a, b in windows(*open_, limits)]
    if not out:
        out = [(a, b, None, None) for a, b in windows(1, len(lines), limits)]
    rows = [(a, b, "\n".join(lines[a - 1 : b]), kind, name) for a, b, kind, name in sorted(out, key=lambda p: p[:2])]
    return [r for r in rows if r[2].strip()]


def symbol_chunks(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row per chunk of files(owner, name, path, content): the columns of a chunk table without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["owner", "name", "file_path", "start_line", "end_line", "content", "symbol_type", "symbol_name"]
        for b in batches:
            rows = []
            for owner, name, path, text in zip(*(b.column(c).to_pylist() for c in ("owner", "name", "path", "content"))):
                dot = path.rfind(".")
                rows += [(owner, name, path, *p) for p in pieces(path[dot:].lower() if dot > path.rfind("/") + 1 else "", text, limits)]
            types = [pa.string()] * 3 + _TYPES
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=names)

    rows = files.select("owner", "name", "path", "content").where("path IS NOT NULL AND content IS NOT NULL AND content <> ''")
    out = rows.mapInArrow(run, "owner string, name string, file_path string, start_line int, end_line int, content string, symbol_type string, symbol_name string")
    return out.select("owner", "name", F.concat(F.col("file_path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line")).alias("chunk_id"), "file_path", "start_line", "end_line", "content", "symbol_name", "symbol_type")
