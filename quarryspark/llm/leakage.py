"""Evaluation passages in training texts, by a generalised suffix automaton.

The passages of a block of evaluation items form one suffix automaton over words. Every document streams its words through it
and tracks the length of the longest match ending at each word. Where a match reaches ``min_words``, the state of its last
``min_words`` words names the items that hold them.

The automaton is broadcast in blocks of at most ``BLOCK_WORDS`` passage words, one pass of the documents per block, so what is
broadcast has a fixed bound however many items there are. An evaluation set of usual size is one block.

Null texts, null passages and passages under ``min_words`` words leak nothing. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

MIN_WORDS = 13
#: Passage words in one automaton: at most twice as many states, about 60 MB pickled.
BLOCK_WORDS = 400_000
#: A document is dropped whole rather than cut if removed spans cover this share of its words.
DROP_COVERAGE = 0.5

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits in lower case. A run is found before it is lowered, as lowering can add signs."""
    if text.isascii() or "İ" not in text:
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]


class SuffixAutomaton:
    """Generalised suffix automaton: one start state, each passage added from it, states shared."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.items: list[set[int]] = [set()]
        self.ids: dict[str, int] = {}

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.items.append(set())
        return len(self.size) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, p: int, w: int) -> int:
        q = self.step[p].get(w)
        if q is not None:
            # the word continues a passage that is known already
            return q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        new = self._new(self.size[p] + 1, {}, 0)
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        return new

    def add(self, passage: list[str], item: int, ends: list[tuple[int, int]]) -> None:
        state = 0
        for w in passage:
            state = self._extend(state, self.ids.setdefault(w, len(self.ids)))
            ends.append((state, item))

    def finish(self, ends: list[tuple[int, int]], min_words: int) -> None:
        """Give the items of every prefix state to its suffixes of min_words words or more."""
        for state, item in ends:
            while state > 0 and self.size[state] >= min_words and item not in self.items[state]:
                self.items[state].add(item)
                state = self.link[state]


def build(passages: list[tuple[int, str]], min_words: int) -> SuffixAutomaton:
    sam = SuffixAutomaton()
    ends: list[tuple[int, int]] = []
    for item, passage in passages:
        w = words(passage)
        if len(w) >= min_words:
            sam.add(w, item, ends)
    sam.finish(ends, min_words)
    return sam


def matches(sam: SuffixAutomaton, text: str, min_words: int) -> list[tuple[int, int, int]]:
    """(item, first word, last word) of maximal spans of the text, words from 0, each in one passage of the item."""
    step, link, size, items = sam.step, sam.link, sam.size, sam.items
    lookup, root = sam.ids.get, step[0]
    state = length = 0
    open_: dict[int, list[int]] = {}
    out: list[tuple[int, int, int]] = []
    for i, w in enumerate(words(text)):
        k = lookup(w)
        if k is None:
            state = length = 0
            continue
        while True:
            nxt = step[state].get(k)
            if nxt is not None:
                state = nxt
                length += 1
                break
            if state == 0:
                length = 0
                break
            state = link[state]
            length = size[state]
        if length >= min_words:
            at = state
            while size[link[at]] >= min_words:
                at = link[at]
            for item in items[at]:
                span = open_.get(item)
                if span is not None and span[1] == i - 1:
                    span[1] = i
                else:
                    if span is not None:
                        out.append((item, span[0], span[1]))
                    open_[item] = [i - min_words + 1, i]
    out.extend((item, a, b) for item, (a, b) in open_.items())
    return sorted(out)


def _passages(items: DataFrame, min_words: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items of at most BLOCK_WORDS words, one block in the driver's memory at a time."""
    block, n = [], 0
    rows = require(items, "item_id", "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    for r in rows.toLocalIterator():
        k = len(words(r.passage))
        if k < min_words:
            continue
        if block and n + k > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((r.item_id, r.passage))
        n += k
    yield block


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, n_words): spans of a document that stand in an item's passage.

    A null doc_id is left out, as a result without an id names nothing. A passage is streamed whole, whatever its length.
    """
    docs = require(documents, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    context = documents.sparkSession.sparkContext
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("n_words", pa.int32())])

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam = shared.value
            for b in batches:
                rows = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    found = matches(sam, text, min_words)
                    if found:
                        n = len(words(text))
                        rows += [(doc, item, lo, hi, n) for item, lo, hi in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

        return run

    parts = [docs.mapInArrow(scan(context.broadcast(build(block, min_words))), "doc_id bigint, item_id bigint, first_word int, last_word int, n_words int") for block in _passages(items, min_words)]
    return reduce(DataFrame.unionByName, parts)


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct (doc_id, item_id)."""
    return leaked_spans(documents, items, min_words).select("doc_id", "item_id").distinct()


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the word spans, words removed, words in all."""
    at = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    pieces, last = [], 0
    for lo, hi in merged:
        pieces.append(text[last : at[lo][0]])
        last = at[hi][1]
    return "".join([*pieces, text[last:]]), sum(hi - lo + 1 for lo, hi in merged), len(at)


_CLEAN = "doc_id bigint, items array<bigint>, removed_words int, coverage double, dropped boolean, text string"


def _cleaned(rows: Iterator[tuple[int, str, list[int], list[tuple[int, int]]]], drop_coverage: float) -> pa.RecordBatch:
    out = []
    for doc, text, items, spans in rows:
        clean, removed, n = _cut(text, spans)
        drop = removed >= drop_coverage * n
        out.append((doc, items, removed, round(removed / n, 6), drop, None if drop else clean))
    types = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.float64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=["doc_id", "items", "removed_words", "coverage", "dropped", "text"])


def decontaminate(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, drop_coverage: float = DROP_COVERAGE) -> DataFrame:
    """Per leaking document: items (sorted), removed_words, coverage, dropped, and text with the spans cut out, null if dropped.

    With one block of items, texts are cut in the pass that finds the spans; with more, the spans of all passes are joined to the texts.
    """
    blocks = _passages(items, min_words)
    first = next(blocks)
    docs = require(documents, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    if next(blocks, None) is None:
        shared = documents.sparkSession.sparkContext.broadcast(build(first, min_words))

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    if found := matches(shared.value, text, min_words):
                        rows.append((doc, text, sorted({i for i, _, _ in found}), [(lo, hi) for _, lo, hi in found]))
                yield _cleaned(rows, drop_coverage)

        return docs.mapInArrow(one_pass, _CLEAN).dropDuplicates(["doc_id"])
    spans = leaked_spans(documents, items, min_words)
    per = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.collect_set(F.struct("first_word", "last_word")).alias("spans"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("doc_id", "text", "items", "spans"))
            yield _cleaned([(d, t, i, [(s["first_word"], s["last_word"]) for s in x]) for d, t, i, x in zip(*columns)], drop_coverage)

    return docs.join(per, "doc_id").dropDuplicates(["doc_id"]).mapInArrow(joined, _CLEAN)
