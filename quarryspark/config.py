"""Limits and fixed values of the retrieval engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    window_lines: int = 120
    window_overlap: int = 20
    max_symbol_lines: int = 150
    max_split_depth: int = 3
    max_file_bytes: int = 1_000_000
    preview_chars: int = 200
    rerank_chars: int = 2000
    file_listing: int = 200
    chunk_listing: int = 100
    pool: int = 20
    answer_chunks: int = 6
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    symbol_weight: int = 3
    dimensions: int = 64
    cache_entries: int = 64
    rate_calls: int = 10
    rate_seconds: int = 60
    max_read_lines: int = 200
    max_tool_calls: int = 12


LIMITS = Limits()

# fixed values: what file selection skips and how it names the reason
EXTENSIONS = [".py", ".java", ".js", ".ts", ".tsx", ".md"]
IGNORED_DIRECTORIES = [".git", ".github", "node_modules", "dist", "build", "target", "out", "bin", "obj", "venv", ".venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", "vendor", "coverage", ".next", ".nuxt", "migrations"]
SKIP_IGNORED, SKIP_EXTENSION, SKIP_UNREADABLE, SKIP_SIZE, SKIP_BINARY, SKIP_SECRET = "uretilmis_klasor", "desteklenmeyen_uzanti", "okunamadi", "cok_buyuk", "binary_veya_bozuk", "sir_iceriyor"
SECRET_PATTERNS = [r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\bAIza[0-9A-Za-z_\-]{35}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"]
ROOT_DIRECTORY = "(kok)"

# fixed values: wording that marks a refusal
REFUSAL_MARKERS = ["could not find", "couldn't find", "cannot find", "can't find", "not enough evidence", "no evidence", "insufficient evidence", "did not find", "didn't find", "unable to find", "no relevant", "don't have enough", "do not have enough"]

# fixed values: what a relative script import may stand for, in order
SCRIPT_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
