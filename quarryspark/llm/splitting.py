"""Oversized chunks cut at natural boundaries, by agglomerative merging.

The lines of a chunk are the atoms. Every boundary between two atoms has a strength: low inside a statement, higher between
statements, paragraphs and members. Adjacent pairs wait in a heap; the weakest boundary is merged first while the merged piece
and its overlap stay within both limits. What cannot be merged any more are the pieces, so cuts fall on the strongest boundaries
the limits allow.

Sizes: ``max_lines`` lines and ``max_chars`` characters hold for a piece with its overlap. The overlap is the last
``overlap_lines`` lines before the piece, fewer only where these leave no room for the next line; where not one line does, its last
``overlap_chars`` characters, or as many as fit.
Where lines are dense, a piece is mostly overlap and may advance by one line only, so output grows: at worst every piece repeats ``max_chars`` less one line.
A line over ``max_chars`` is an atom list of its own, cut after signs and blanks, with ``overlap_chars`` characters shared.

Null contents have no size and are never oversized; blank lines count as lines. Line numbers start at the one in ``chunk_id``,
else at the lesser of start_line and end_line, else at 1. Repeated rows of a point count once.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

MAX_LINES, MAX_CHARS, OVERLAP_LINES, OVERLAP_CHARS = 150, 8000, 20, 200

_MEMBER = re.compile(r"(?:export |default |public |private |protected |static |final |abstract |async |@)*(?:def|class|function|interface|enum|record|type|const|let|var|public|private|protected|import|from|package|@\w+)\b|#{1,6} |@\w")
_CLOSER = re.compile(r"[\]})]|(?:else|elif|except|finally|catch)\b")
_OPEN_END = re.compile(r"(?:[,(\[{\\+*/=&|<:]|\band|\bor|\breturn)$")
_COMMENT = re.compile(r"(?:#(?!#* )|//|/\*|\*|@\w|<!--)")
_INLINE = re.compile(r"[;}]+\s*|[.!?]+\s+|,\s*|\s+")


def agglomerate(n: int, strength: list[float], fits: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Atom ranges [lo, hi) after merging the weakest of n - 1 boundaries first; ties go to the leftmost."""
    end = list(range(1, n + 1))
    start = list(range(n))
    heap = [(strength[i], i) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        # boundary i lies between atoms i and i + 1; it never changes, only the pieces beside it grow,
        # and a pair that does not fit once cannot fit later
        _, i = heapq.heappop(heap)
        lo, hi = start[i], end[i + 1]
        if fits(lo, hi):
            end[lo] = hi
            start[hi - 1] = lo
    out, lo = [], 0
    while lo < n:
        out.append((lo, end[lo]))
        lo = end[lo]
    return out


def line_strengths(lines: list[str]) -> list[float]:
    out = []
    for before, after in zip(lines, lines[1:]):
        b, a = before.strip(), after.strip()
        indent = len(after) - len(after.lstrip())
        s = 10.0 - min(indent, 16) / 2
        if not a:
            # a blank line stays with what precedes it
            s -= 9
        if not b:
            s += 6
        elif b in ("}", "};", "});", "]", "];", ")", ");", "```"):
            s += 3
        if _MEMBER.match(a):
            s += 4
        if _CLOSER.match(a):
            s -= 8
        if b and _OPEN_END.search(b):
            s -= 8
        if _COMMENT.match(b) and a:
            s -= 6
        out.append(s)
    return out


def _long_line(text: str, first: int, room: Callable[[int], int]) -> list[tuple[int, int]]:
    """Character ranges of one line; room(k) is the size that atom range starting at character k may have."""
    atoms, last = [], 0
    for m in _INLINE.finditer(text):
        atoms.append((last, m.end()))
        last = m.end()
    if last < len(text):
        atoms.append((last, len(text)))
    # without a natural boundary within reach, cut hard
    step = max(1, first)
    cut = [(a, min(a + step, hi)) for lo, hi in atoms for a in range(lo, hi, step)]
    rank = {";": 4, "}": 4, ".": 3, "!": 3, "?": 3, ",": 2}
    strength = [float(rank.get(text[a:b].rstrip()[-1:], 1 if text[b - 1 : b].isspace() else 0)) for a, b in cut[:-1]]
    return [(cut[lo][0], cut[hi - 1][1]) for lo, hi in agglomerate(len(cut), strength, lambda lo, hi: cut[hi - 1][1] - cut[lo][0] <= room(cut[lo][0]))]


def split(text: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """Pieces (start of overlap, start, end) as character offsets; the starts and ends are a partition of the text."""
    # a final line feed belongs to the last line and counts as a line and a character of its piece
    final = int(text.endswith("\n"))
    lines = (text[:-1] if final else text).split("\n")
    at = [0]
    for ln in lines:
        at.append(at[-1] + len(ln) + 1)
    extra = lambda hi: final if hi == len(lines) else 0

    def overlap(lo: int, hi: int) -> int:
        """First line of the overlap of lines [lo, hi): what the limits leave, at most overlap_lines."""
        k = max(0, lo - min(overlap_lines, max_lines - (hi - lo) - extra(hi)))
        room = max_chars - (at[hi] - 1 - at[lo]) - extra(hi)
        while k < lo and at[lo] - at[k] > room:
            k += 1
        return k

    def fits(lo: int, hi: int) -> bool:
        # a piece may grow only while its overlap stays what it was for its first line
        k = overlap(lo, lo + 1)
        return hi - k + extra(hi) <= max_lines and at[hi] - 1 - at[k] + extra(hi) <= max_chars

    long = [j for j, ln in enumerate(lines) if len(ln) + extra(j + 1) > max_chars]
    strength = line_strengths(lines)
    pieces: list[tuple[int, int, int]] = []
    done = 0
    for j in [*long, len(lines)]:
        if done < j:
            base = done
            for lo, hi in agglomerate(j - base, strength[base : j - 1], lambda lo, hi: fits(base + lo, base + hi)):
                lo, hi = base + lo, base + hi
                k = max([overlap(lo, hi), *(x + 1 for x in long if x < lo)])
                o = at[k]
                if k == lo > 0:
                    # no whole line before fits: share its last characters
                    n = min(overlap_chars, max_chars - (at[hi] - at[lo]) - extra(hi), at[lo] - 1 - at[lo - 1])
                    o = at[lo] - 1 - n if n > 0 and hi - lo + extra(hi) < max_lines else at[lo]
                pieces.append((o, at[lo], min(at[hi], len(text))))
        if j < len(lines):
            line = lines[j] + "\n" * extra(j + 1)
            k = max([0, j - overlap_lines, *(x + 1 for x in long if x < j)])
            # room stays for a first part of the line that is no shorter than an overlap
            while k < j and at[j] - at[k] > max_chars - 2 * overlap_chars:
                k += 1
            head = at[j] - at[k]
            if k == j > 0:
                head = min(overlap_chars, at[j] - 1 - at[j - 1]) + 1
            room = lambda c: max_chars - (head if c == 0 else overlap_chars)
            for lo, hi in _long_line(line, max_chars - max(head, overlap_chars), room):
                o = at[j] + lo - overlap_chars if lo else at[j] - head
                pieces.append((o, at[j] + lo, min(at[j] + hi + (hi == len(lines[j])), len(text))))
            done = j + 1
    return pieces


def oversized(chunks: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    rows = require(chunks, "point_id", "chunk_id", "start_line", "end_line", "symbol_name", "content")
    size = F.length("content") - F.length(F.translate("content", "\n", "")) + 1
    return rows.where(F.col("point_id").isNotNull()).where((F.length("content") > max_chars) | (size > max_lines)).dropDuplicates(["point_id"])


def split_oversized(chunks: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Pieces of every oversized chunk, in order from 0. start_line and end_line include the overlap."""
    if not (max_lines > overlap_lines >= 0 and max_chars > 2 * overlap_chars >= 0):
        raise ValueError("the overlap must leave room within the limits")
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = ["point_id", "piece", "start_line", "end_line", "overlap_lines", "overlap_chars", "symbol_name", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text = r["content"]
                m = re.search(r":(\d+)-(\d+)$", r["chunk_id"] or "")
                first = min(map(int, m.groups())) if m else min((x for x in (r["start_line"], r["end_line"]) if x is not None), default=1)
                feeds = [m.start() for m in re.finditer("\n", text)]
                for n, (o, lo, hi) in enumerate(split(text, max_lines, max_chars, overlap_lines, overlap_chars)):
                    body = text[o:hi]
                    if hi < len(text) and body.endswith("\n"):
                        body = body[:-1]
                    start = first + bisect_right(feeds, o - 1)
                    rows.append((r["point_id"], n, start, start + body.count("\n"), text.count("\n", o, lo), lo - o, r["symbol_name"], body))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    return oversized(chunks, max_lines, max_chars).mapInArrow(run, "point_id bigint, piece int, start_line int, end_line int, overlap_lines int, overlap_chars int, symbol_name string, content string")
