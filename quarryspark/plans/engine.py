"""The engine: what a service would call, over an index store.

Models are pluggable: an Embedder turns (key, text) rows into (key, embedding), a scorer turns query and document columns into a score, an
Answerer turns a question and its hits into a text. The defaults need no model: hashed term frequencies, lexical overlap, extraction;
``operators.model`` makes an embedder or scorer of a model that each worker loads once. Several answerers form a chain: where one is busy or says nothing, the next is asked.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import LIMITS, REFUSAL_MARKERS
from ..errors import EngineError
from ..functions.addresses import check_reference, failure, is_retriable
from ..functions.text import line_array, preview
from ..operators import citations, evaluate, fusion, graph, incremental, prompts, scan, symbol_chunks, vector
from ..operators.line_chunks import chunk_totals
from ..operators.replay import AnswerCache, RateLimiter
from ..schemas import HIT_FIELDS, JOB_STATES, SEARCH_MODES
from ..sources.checkpoints import settle
from ..sources.repository import confined, head_commit, pull_latest, read_checkout
from ..sources.store import IndexStore

NO_EVIDENCE = "I could not find enough evidence in the indexed code to answer this."
WRAP_UP = "No further lookups are possible. Answer now, from the excerpts above alone, and cite them."


class Answerer(Protocol):
    def __call__(self, question: str, prompt: str, hits: list[Row]) -> str: ...


class Embedder(Protocol):
    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...


class Chunker(Protocol):
    def __call__(self, files: DataFrame) -> DataFrame: ...


def extractive_answer(question: str, prompt: str, hits: list[Row]) -> str:
    """The best hit and its place; a refusal without a hit."""
    if not hits:
        return NO_EVIDENCE
    h = hits[0]
    return f"{(h.content or '').strip().splitlines()[0][:200] if (h.content or '').strip() else h.file_path} ({h.file_path}:{h.start_line}-{h.end_line})"


@dataclass
class Job:
    owner: str
    name: str
    state: str = JOB_STATES[0]
    error: str | None = None
    chunks: int = 0
    seconds: float = 0.0
    #: States in the order they were entered, with the seconds since the start.
    history: list[tuple[str, float]] = field(default_factory=list)


@dataclass
class Step:
    tool: str
    argument: str
    results: int


@dataclass
class Recorder:
    """Steps in order, and evidence without repetition: the first hit of a chunk stays."""

    steps: list[Step] = field(default_factory=list)
    evidence: dict[str, Row] = field(default_factory=dict)

    def add(self, tool: str, argument: str, hits: list[Row]) -> None:
        self.steps.append(Step(tool, argument, len(hits)))
        for h in hits:
            self.evidence.setdefault(h.chunk_id, h)


class Engine:
    def __init__(self, spark: SparkSession, root: str | Path, embed: Embedder = vector.embed, scorer: Callable = fusion.lexical_score, answerer: Answerer | list[Answerer] = extractive_answer, chunker: Chunker = symbol_chunks.symbol_chunks) -> None:
        self.spark, self.store = spark, IndexStore(spark, root)
        self.embed, self.scorer, self.chunker = embed, scorer, chunker
        self.answerers = answerer if isinstance(answerer, list) else [answerer]
        self.sources: dict[tuple[str, str], tuple[DataFrame, str]] = {}
        self.jobs: dict[tuple[str, str], Job] = {}
        self.running: dict[tuple[str, str], Future] = {}
        self.lock = threading.Lock()
        self.pool = ThreadPoolExecutor(max_workers=2, thread_name_prefix="index")
        self.cache, self.limiter = AnswerCache(), RateLimiter()

    def ping(self) -> str:
        return "ok"

    # repositories and files

    def add_repository(self, owner: str, name: str, files: DataFrame | str | Path, commit: str | None = None) -> str:
        """files(path, content) or a checkout's path. Returns the commit."""
        check_reference(owner, name)
        if isinstance(files, (str, Path)):
            commit = commit or head_commit(files)
            df = read_checkout(self.spark, files, owner, name)
        else:
            df = files.select(F.lit(owner).alias("owner"), F.lit(name).alias("name"), "path", F.octet_length("content").cast("bigint").alias("size_bytes"), F.size(line_array(F.col("content"))).alias("lines"), "content")
        self.sources[(owner, name)] = (df, commit or "unknown")
        return commit or "unknown"

    def pull(self, owner: str, name: str, checkout: str | Path) -> str:
        return self.add_repository(owner, name, checkout, pull_latest(checkout))

    def _source(self, owner: str, name: str) -> tuple[DataFrame, str]:
        if (owner, name) not in self.sources:
            raise EngineError("no such repository", 404)
        return self.sources[(owner, name)]

    def scanned(self, owner: str, name: str) -> DataFrame:
        df, _ = self._source(owner, name)
        return df.withColumns({"extension": scan.file_extension(F.col("path")), "skip_reason": scan.skip_reason(F.col("path"), F.col("size_bytes"), F.col("content"))})

    def selected(self, owner: str, name: str) -> DataFrame:
        return self.scanned(owner, name).where("skip_reason IS NULL")

    def files(self, owner: str, name: str) -> dict[str, Any]:
        """Summaries of all files, and a listing that may be cut."""
        rows, chosen = self.scanned(owner, name), self.selected(owner, name)
        listed, truncated = scan.listing(chosen.drop("content"), LIMITS.file_listing, "path")
        return {"totals": scan.totals(rows), "skipped": rows.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n")), "by_extension": scan.by_extension(chosen), "by_directory": scan.by_top_directory(chosen), "largest": scan.largest_files(chosen.withColumn("file_id", F.col("path"))), "files": listed, "truncated": truncated}

    def chunked(self, owner: str, name: str) -> DataFrame:
        return self.chunker(self.selected(owner, name))

    def chunks(self, owner: str, name: str) -> dict[str, Any]:
        df = self.chunked(owner, name)
        listed, truncated = scan.listing(df.withColumn("preview", preview(F.col("content"))).drop("content"), LIMITS.chunk_listing, "file_path", "start_line", "end_line")
        return {"totals": chunk_totals(df), "by_symbol_type": scan.count_by(df, F.col("symbol_type"), "symbol_type"), "chunks": listed, "truncated": truncated}

    def dependencies(self, owner: str, name: str) -> tuple[DataFrame, DataFrame]:
        files = self.selected(owner, name)
        return graph.dependency_nodes(files).orderBy("path"), graph.dependency_edges(files).orderBy("source", "target")

    # indexing

    def _with_vectors(self, chunks: DataFrame) -> DataFrame:
        """Chunks, settled so that files are parsed once, with their vectors."""
        keyed = settle(chunks.withColumn("point_id", F.xxhash64("owner", "name", "chunk_id")))
        return keyed.join(self.embed(keyed, "point_id", "content"), "point_id", "left")

    def start_index(self, owner: str, name: str) -> Job:
        """Queues an index job and returns at once; a repository whose job still runs gets that one."""
        self._source(owner, name)
        with self.lock:
            running = self.running.get((owner, name))
            if running is not None and not running.done():
                return self.jobs[(owner, name)]
            job = self.jobs[(owner, name)] = Job(owner, name, history=[(JOB_STATES[0], 0.0)])
            self.running[(owner, name)] = self.pool.submit(inheritable_thread_target(self.spark)(lambda: self._run(job)))
        return job

    def index(self, owner: str, name: str) -> Job:
        """An index job, waited for."""
        job = self.start_index(owner, name)
        self.running[(owner, name)].result()
        return job

    def _run(self, job: Job) -> None:
        began = time.monotonic()

        def enter(state: str) -> None:
            job.history.append((state, time.monotonic() - began))
            job.state = state

        try:
            owner, name = job.owner, job.name
            self.spark.sparkContext.setJobGroup(f"index {owner}/{name}", f"index {owner}/{name}")
            _, commit = self._source(owner, name)
            enter("parsing")
            keyed = settle(self.chunked(owner, name).withColumn("point_id", F.xxhash64("owner", "name", "chunk_id")))
            enter("embedding")
            vectors = keyed.select("point_id").join(self.embed(keyed, "point_id", "content"), "point_id", "left")
            job.chunks = self.store.write(owner, name, keyed, incremental.snapshot(self.selected(owner, name)), commit, vectors)["chunks"]
            job.seconds = time.monotonic() - began
            enter("ready")
        except Exception as e:
            job.error, job.seconds = str(e), time.monotonic() - began
            enter("failed")

    def index_status(self, owner: str, name: str) -> Job:
        if (owner, name) not in self.jobs:
            raise EngineError("no index job", 404)
        return self.jobs[(owner, name)]

    def reindex(self, owner: str, name: str) -> dict[str, Any]:
        """Brings the index to the repository's commit, chunking only what changed. The state is saved with every index."""
        _, commit = self._source(owner, name)
        if not self.store.exists(owner, name):
            job = self.index(owner, name)
            if job.state == "failed":
                raise EngineError(job.error or "index failed", 500)
            return {"previous": None, "commit": commit, "added": job.chunks, "modified": 0, "deleted": 0, "unchanged": 0, "chunks": job.chunks}
        previous = self.store.describe(owner, name)["commit"]
        old = self.store.state(owner, name)
        if previous == commit and commit != "unknown":
            return {"previous": previous, "commit": commit, "added": 0, "modified": 0, "deleted": 0, "unchanged": old.count(), "chunks": self.store.count(owner, name)}
        files = self.selected(owner, name)
        new = incremental.snapshot(files)
        # read three times: by what is chunked again, by what stays, and by the counts
        diff = settle(incremental.difference(old, new))
        fresh = self._with_vectors(self.chunker(incremental.to_index(diff, files)))
        kept = incremental.upsert(self.store.chunks(owner, name), fresh, diff)
        counts = diff.agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "deleted", "unchanged")]).first().asDict()
        n = self.store.write(owner, name, kept, new, commit)["chunks"]
        return {"previous": previous, "commit": commit, **counts, "chunks": n}

    # retrieval

    def _queries(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id bigint, query string")

    def ranked(self, owner: str, name: str, query: str, mode: str = "hybrid", limit: int = 5, rerank: bool = False) -> DataFrame:
        """Hits in rank order with the columns of their chunk."""
        if mode not in SEARCH_MODES:
            raise EngineError("unknown mode", 422)
        if not 1 <= len(query) <= 1000 or not 1 <= limit <= 20:
            raise EngineError("query or limit out of bounds", 422)
        chunks, index = self.store.chunks(owner, name), self.store.search_index(owner, name)
        q = self._queries(query)
        pool = LIMITS.pool if rerank else limit
        keyword = lambda n: index.keyword(q, n)
        semantic = lambda n: index.semantic(q, n, self.embed)
        if mode == "keyword":
            hits = keyword(pool)
        elif mode == "semantic":
            hits = semantic(pool)
        else:
            hits = fusion.fuse(semantic(LIMITS.pool), keyword(LIMITS.pool), pool)
        if rerank:
            hits = fusion.rerank(settle(hits), q, chunks, limit, self.scorer)
        return hits.join(chunks.drop("embedding"), "point_id").orderBy("rank")

    def search(self, owner: str, name: str, query: str, mode: str = "hybrid", limit: int = 5, rerank: bool = False) -> list[Row]:
        """A top-k of at most twenty rows."""
        return self.ranked(owner, name, query, mode, limit, rerank).collect()

    def ask(self, owner: str, name: str, question: str, limit: int = 5, now: float | None = None) -> dict[str, Any]:
        key = (owner, name, self.store.version(owner, name), question, limit)
        if (kept := self.cache.get(key)) is not None:
            return kept
        self.limiter.check(time.monotonic() if now is None else now)
        hits = self.search(owner, name, question, "hybrid", limit, True)
        result = self._answered(question, hits)
        self.cache.put(key, result)
        return result

    def _said(self, question: str, prompt: str, hits: list[Row]) -> str:
        """The first text of the chain. A busy answerer and an empty text lead to the next one, any other failure ends the chain."""
        last: Exception | None = None
        for answerer in self.answerers:
            try:
                text = (answerer(question, prompt, hits) or "").strip()
            except Exception as e:
                last = e
                if is_retriable(str(e)):
                    continue
                message, status = failure(str(e))
                raise EngineError(message, status) from e
            if text:
                return text
            last = None
        if last is not None:
            raise EngineError("all models are busy or over their limits; try again in a few minutes", 503) from last
        raise EngineError("the model gave an empty answer", 502)

    def _answered(self, question: str, hits: list[Row], note: str = "") -> dict[str, Any]:
        table = self._hit_table(hits)
        prompt = prompts.prompts(self._queries(question), table).first().prompt + (f"\n\n{note}" if note else "")
        text = self._said(question, prompt, hits) if hits else NO_EVIDENCE
        checked = self.verify(text, table)
        return {"answer": text, "citations": checked, "unverified": sum(c.status != "verified" for c in checked), "hits": hits, "refused": any(m in text.lower() for m in REFUSAL_MARKERS)}

    @staticmethod
    def serialised(hits: list[Row]) -> list[dict[str, Any]]:
        """Hits as records with the same fields whatever search they come from."""
        return [{k: h[k] if k in h else None for k in HIT_FIELDS} for h in hits]

    def _hit_table(self, hits: list[Row]) -> DataFrame:
        rows = [(0, i, h.point_id, h.file_path, h.start_line, h.end_line, h.symbol_type, h.symbol_name, h.content) for i, h in enumerate(hits, 1)]
        return self.spark.createDataFrame(rows, "query_id bigint, rank int, point_id bigint, file_path string, start_line int, end_line int, symbol_type string, symbol_name string, content string")

    def verify(self, answer: str, hits: DataFrame) -> list[Row]:
        answers = self.spark.createDataFrame([(0, answer)], "id bigint, answer string")
        return citations.verify(citations.extracted(answers), hits, []).orderBy("position").collect()

    # tools of an investigation

    def read_file(self, owner: str, name: str, path: str, start: int = 1, end: int = LIMITS.max_read_lines) -> list[str]:
        df, _ = self._source(owner, name)
        start = max(1, start)
        end = min(end, start + LIMITS.max_read_lines - 1)
        row = df.where(F.col("path") == confined(path)).select(F.slice(line_array(F.col("content")), start, max(0, end - start + 1)).alias("l")).first()
        if row is None:
            raise EngineError("no such file", 404)
        return row.l or []

    def tools(self, owner: str, name: str, recorder: Recorder) -> dict[str, Callable[..., list]]:
        def run(tool: str, find: Callable[[str], list[Row]]) -> Callable[[str], list[Row]]:
            def call(argument: str) -> list[Row]:
                hits = find(argument)
                recorder.add(tool, argument, hits)
                return hits

            return call

        def tests(query: str) -> list[Row]:
            return [h for h in self.search(owner, name, query, "hybrid", LIMITS.pool) if "test" in h.file_path.lower()][:5]

        def read(argument: str) -> list[str]:
            path, _, lines = argument.partition(":")
            lo, _, hi = lines.partition("-")
            start = int(lo or 1)
            found = self.read_file(owner, name, path, start, int(hi or start + LIMITS.max_read_lines - 1))
            row = Row(chunk_id=f"{path}:{start}-{start + len(found) - 1}", point_id=None, file_path=path, start_line=start, end_line=start + len(found) - 1, content="\n".join(found), symbol_name=None, symbol_type=None, score=0.0)
            recorder.add("read_file", argument, [row] if found else [])
            return found

        return {
            "search_code": run("search_code", lambda q: self.search(owner, name, q, "hybrid", 5, True)),
            "search_symbol": run("search_symbol", lambda q: self.search(owner, name, q, "keyword", 5)),
            "find_references": run("find_references", lambda q: self.search(owner, name, q, "keyword", 10)),
            "read_tests": run("read_tests", tests),
            "read_file": read,
        }

    def investigate(self, owner: str, name: str, question: str, plan: Callable[[str, list[Step]], tuple[str, str] | None] | None = None, now: float | None = None) -> dict[str, Any]:
        """Tool calls that a planner asks for, at most twelve; then an answer from all evidence seen. Where the calls run out, the prompt says that it is time to answer."""
        self.store.describe(owner, name)
        self.limiter.check(time.monotonic() if now is None else now)
        recorder = Recorder()
        tools = self.tools(owner, name, recorder)
        plan = plan or (lambda q, steps: ("search_code", q) if not steps else None)
        note = WRAP_UP
        for _ in range(LIMITS.max_tool_calls):
            step = plan(question, recorder.steps)
            if step is None:
                note = ""
                break
            if step[0] not in tools:
                raise EngineError("unknown tool", 400)
            tools[step[0]](step[1])
        return {**self._answered(question, list(recorder.evidence.values()), note), "steps": recorder.steps, "wrapped_up": bool(note)}

    # evaluation

    VARIANTS = ("semantic", "keyword", "hybrid", "hybrid_rerank")

    def _variant(self, owner: str, name: str, q: DataFrame, variant: str, limit: int = 10) -> DataFrame:
        """(query_id, rank, point_id) of queries(query_id, query) in one plan."""
        index = self.store.search_index(owner, name)
        keyword, semantic = (lambda n: index.keyword(q, n)), (lambda n: index.semantic(q, n, self.embed))
        if variant == "keyword":
            return keyword(limit)
        if variant == "semantic":
            return semantic(limit)
        if variant == "hybrid":
            return fusion.fuse(semantic(LIMITS.pool), keyword(LIMITS.pool), limit)
        if variant != "hybrid_rerank":
            raise EngineError("unknown variant", 422)
        pool = settle(fusion.fuse(semantic(LIMITS.pool), keyword(LIMITS.pool), LIMITS.pool))
        return fusion.rerank(pool, q, self.store.chunks(owner, name), limit, self.scorer)

    def warm_up(self, owner: str, name: str, question: str) -> None:
        """Each path once, so that no variant pays for loading models or opening the index."""
        q = self._queries(question)
        for variant in self.VARIANTS:
            self._variant(owner, name, q, variant, 1).collect()

    def _correct(self, owner: str, name: str, questions: DataFrame, variant: str) -> tuple[DataFrame, DataFrame]:
        hits = self._variant(owner, name, questions.select("query_id", "query"), variant)
        files = settle(evaluate.ranked_files(hits.join(self.store.chunks(owner, name).select("point_id", "file_path"), "point_id")))
        return evaluate.first_correct(files, questions), files

    def evaluate(self, owner: str, name: str, questions: DataFrame, variant: str = "hybrid") -> DataFrame:
        """Ranking metrics of questions(query_id, query, category, expected_files) in one plan."""
        return evaluate.ranking_metrics(self._correct(owner, name, questions, variant)[0])

    def compare(self, owner: str, name: str, questions: DataFrame, variants: tuple[str, ...] = VARIANTS) -> dict[str, Any]:
        """Side by side: overall metrics and seconds a question of each variant, recall at 1 by category, the best variant and what it misses."""
        n = max(1, questions.count())
        overall, by_category, misses, seconds = None, None, {}, {}
        for variant in variants:
            began = time.perf_counter()
            correct, files = self._correct(owner, name, questions, variant)
            correct = settle(correct)
            seconds[variant] = (time.perf_counter() - began) / n
            tagged = correct.withColumn("variant", F.lit(variant))
            one, per = evaluate.ranking_metrics(tagged, "variant"), evaluate.ranking_metrics(tagged, "variant", "category")
            overall, by_category = (one, per) if overall is None else (overall.unionByName(one), by_category.unionByName(per))
            misses[variant] = evaluate.misses(correct, files)
        overall = settle(overall)
        best = evaluate.best_variant(overall).first().variant
        return {"questions": n, "overall": overall.orderBy("variant").collect(), "by_category": evaluate.side_by_side(by_category, list(variants)).orderBy("category").collect(), "best": best, "misses": misses[best].orderBy("query_id").collect(), "seconds": seconds}

    def hallucination_run(self, owner: str, name: str, questions: DataFrame) -> list[dict[str, Any]]:
        """Answers of questions(query_id, id, category, query) about what the repository may not hold: the best six of the reranked pool, an answer, and whether it declines.

        Retrieval is one plan for all questions; answers are asked for one by one, as a model is.
        """
        q = questions.select("query_id", "query")
        hits = self._variant(owner, name, q, "hybrid_rerank", LIMITS.answer_chunks).select("query_id", "rank", "point_id")
        placed = hits.join(self.store.chunks(owner, name, vectors=False), "point_id")
        found: dict[int, list[Row]] = {}
        for h in placed.orderBy("query_id", "rank").toLocalIterator():
            found.setdefault(h.query_id, []).append(h)
        asked = {r.query_id: r.prompt for r in prompts.prompts(q, placed).toLocalIterator()}
        out = []
        for r in questions.orderBy("query_id").toLocalIterator():
            own = found.get(r.query_id, [])
            text = self._said(r.query, asked[r.query_id], own) if own else NO_EVIDENCE
            out.append({"id": r.id, "category": r.category, "question": r.query, "refused": any(m in text.lower() for m in REFUSAL_MARKERS), "answer": text})
        return out
