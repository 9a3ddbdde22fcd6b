"""The engine's functions for SQL: scalar functions that Catalyst inlines, and table functions for chunks.

``register(spark)`` makes temporary functions of the session: qs_lines, qs_line_count, qs_preview, qs_extension, qs_has_secret, qs_tokens,
and the table functions qs_line_windows and qs_symbol_chunks, to be joined with LATERAL.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..config import LIMITS, SECRET_PATTERNS
from ..operators import symbol_chunks


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_LINES = "CASE WHEN text = '' THEN array() WHEN right(replace(text, '\\r\\n', '\\n'), 1) = '\\n' THEN slice(split(replace(text, '\\r\\n', '\\n'), '\\n'), 1, size(split(replace(text, '\\r\\n', '\\n'), '\\n')) - 1) ELSE split(replace(text, '\\r\\n', '\\n'), '\\n') END"
#: Name, arguments, result type and body of the scalar functions.
SCALARS = [
    ("qs_lines", "text STRING", "ARRAY<STRING>", _LINES),
    ("qs_line_count", "text STRING", "INT", "CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, '\\n', '')) + CASE WHEN right(text, 1) = '\\n' THEN 0 ELSE 1 END END"),
    ("qs_preview", "text STRING", "STRING", f"CASE WHEN length(text) > {LIMITS.preview_chars} THEN concat(substring(text, 1, {LIMITS.preview_chars}), '...') ELSE text END"),
    ("qs_extension", "path STRING", "STRING", "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.].*?(\\\\.[^.]+)$', 1))"),
    ("qs_has_secret", "text STRING", "BOOLEAN", " OR ".join(f"regexp_like(text, {_quoted(p)})" for p in SECRET_PATTERNS)),
    ("qs_tokens", "text STRING", "ARRAY<STRING>", "flatten(transform(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*|[0-9]+)', 1), w -> concat(array(lower(w)), filter(transform(split(w, '_|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])'), p -> lower(p)), p -> p <> '' AND p <> lower(w)))))"),
]


@udtf(returnType="start_line int, end_line int, content string")
class LineWindows:
    """Windows of a text's lines; none for a null or empty text, and none that is blank."""

    def eval(self, text: str) -> Iterator[tuple]:
        lines = (text or "").replace("\r\n", "\n").split("\n")
        if lines[-1] == "":
            lines.pop()
        for a, b in symbol_chunks.windows(1, len(lines)) if lines else ():
            content = "\n".join(lines[a - 1 : b])
            if content.strip():
                yield a, b, content


@udtf(returnType="start_line int, end_line int, content string, symbol_type string, symbol_name string")
class SymbolChunks:
    """Chunks along the declarations of a text in the language of its path."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        if path and text:
            name = path.rpartition("/")[2]
            dot = name.rfind(".")
            yield from symbol_chunks.pieces(name[dot:].lower() if dot > 0 else "", text)


def register(spark: SparkSession) -> None:
    for name, arguments, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("qs_line_windows", LineWindows)
    spark.udtf.register("qs_symbol_chunks", SymbolChunks)
