"""Registered queries of the retrieval engine. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LIMITS, REFUSAL_MARKERS
from ..functions import addresses, text
from ..operators import bm25, citations, evaluate, fusion, graph, incremental, line_chunks, prompts, replay, scan, symbol_chunks, vector
from ..sources import tables as T
from ..sources.checkpoints import settle
from ..sources.postings import SearchIndex, table_index

Questions = Callable[[SparkSession, str], DataFrame]


def _selection(spark: SparkSession, d: str) -> DataFrame:
    return scan.selection(T.scanned_files(spark, d), T.file_texts(spark, d))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return _selection(spark, d).where("skip_reason IS NULL")


def scan_selection(spark: SparkSession, d: str) -> DataFrame:
    return _selection(spark, d).select("file_id", "extension", "skip_reason")


def scan_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _selection(spark, d).groupBy("skip_reason").agg(F.count("*").alias("n"))


def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    return scan.totals(_selection(spark, d))


def count_by_extension(spark: SparkSession, d: str) -> DataFrame:
    return scan.by_extension(_selected(spark, d))


def count_by_directory(spark: SparkSession, d: str) -> DataFrame:
    return scan.by_top_directory(_selected(spark, d))


def largest_files(spark: SparkSession, d: str) -> DataFrame:
    return scan.largest_files(_selected(spark, d)).select("file_id", "path", "lines")


def secret_files(spark: SparkSession, d: str) -> DataFrame:
    return T.file_texts(spark, d).where(scan.contains_secret(F.col("content"))).select("file_id")


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.file_texts(spark, d).where("content IS NOT NULL").select("file_id", text.count_lines(F.col("content")).cast("bigint").alias("n"), text.content_hash(F.col("content")).alias("sha1"))


def line_windows(spark: SparkSession, d: str) -> DataFrame:
    files = T.file_texts(spark, d).select("file_id", F.col("path").alias("file_path"), "content")
    return line_chunks.line_windows(files).select("file_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.md5("content").alias("digest"))


def symbol_chunking(spark: SparkSession, d: str) -> DataFrame:
    return symbol_chunks.symbol_chunks(T.file_texts(spark, d)).select("owner", "name", "chunk_id", "symbol_type", "symbol_name", text.preview(F.col("content")).alias("preview"))


def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    return line_chunks.chunk_totals(T.chunks(spark, d))


def count_by_symbol_type(spark: SparkSession, d: str) -> DataFrame:
    return scan.count_by(T.chunks(spark, d), F.col("symbol_type"), "symbol_type")


def chunk_previews(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).select("point_id", (F.col("end_line") - F.col("start_line") + 1).alias("line_count"), text.preview(F.col("content")).alias("preview"), F.md5(text.rerank_text(F.col("file_path"), F.col("symbol_name"), F.col("content"))).alias("rerank_digest"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each point: how many, how many distinct, and a digest of their order."""
    tokens = T.chunks(spark, d).select("point_id", text.code_tokens(text.index_text(F.col("file_path"), F.col("content"), F.col("symbol_name"))).alias("tokens"))
    return tokens.select("point_id", F.size("tokens").cast("bigint").alias("n"), F.size(F.array_distinct("tokens")).cast("bigint").alias("distinct_n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return bm25.document_frequency(bm25.tokenized(T.chunks(spark, d)))


def inverse_frequency(spark: SparkSession, d: str) -> DataFrame:
    tokens = bm25.tokenized(T.chunks(spark, d))
    return bm25.inverse_frequency(bm25.document_frequency(tokens), bm25.corpus_stats(tokens)).select("term", F.round("idf", 6).alias("idf"))


def _index(spark: SparkSession, d: str) -> SearchIndex:
    """Postings and vectors of all stored chunks: written at the first search of a session, read by the others."""
    return table_index(spark, f"{d}/chunks.parquet", lambda: T.chunks(spark, d))


def _keyword(spark: SparkSession, d: str, limit: int, questions: Questions = T.eval_questions) -> DataFrame:
    return _index(spark, d).keyword(questions(spark, d), limit)


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d, 10)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20."""
    e = T.table(spark, d, "embeddings").dropDuplicates(["vec_id"])
    vectors = e.select("vec_id", "embedding")
    return vector.search(vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, key="vec_id")


def embedding_buckets(spark: SparkSession, d: str) -> DataFrame:
    return vector.term_buckets(T.chunks(spark, d), "point_id", "content")


def _semantic(spark: SparkSession, d: str, limit: int, questions: Questions = T.eval_questions) -> DataFrame:
    return _index(spark, d).semantic(questions(spark, d), limit)


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d, 10)


def _pools(spark: SparkSession, d: str, questions: Questions = T.eval_questions) -> tuple[DataFrame, DataFrame]:
    """The candidates of both searches, settled: a few rows a query, read by every variant."""
    return settle(_semantic(spark, d, LIMITS.pool, questions)), settle(_keyword(spark, d, LIMITS.pool, questions))


def _hybrid(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return fusion.fuse(_semantic(spark, d, LIMITS.pool), _keyword(spark, d, LIMITS.pool), limit)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, 10)


def _reranked(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return fusion.rerank(settle(_hybrid(spark, d, LIMITS.pool)), T.eval_questions(spark, d), T.chunks(spark, d), limit)


def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, 5).select("query_id", "rank", "point_id", "score", "rerank_score")


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the stored answers against the chunks of the answer's repository."""
    answers = T.pairs(spark, d).select("id", "owner", "name", "answer")
    hits = T.chunks(spark, d).select("owner", "name", "file_path", "start_line", "end_line", "point_id", F.col("point_id").alias("rank"))
    return citations.verify(citations.extracted(answers), hits, ["owner", "name"]).select("id", "position", "file_path", "start_line", "end_line", "status", "point_id")


def _self_citations(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk cited by itself, its first half and a range beyond it, as one answer per file."""
    c = T.chunks(spark, d).where("start_line IS NOT NULL AND end_line IS NOT NULL")
    cite = lambda a, b: F.concat(F.col("file_path"), F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string"))
    middle = F.floor((F.col("start_line") + F.col("end_line")) / 2)
    line = F.concat_ws(" ", cite(F.col("start_line"), F.col("end_line")), cite(F.col("start_line"), middle), cite(F.col("start_line"), F.col("end_line") + 100_000))
    return c.select(F.col("point_id").alias("id"), "owner", "name", line.alias("answer"))


def citation_containment(spark: SparkSession, d: str) -> DataFrame:
    hits = T.chunks(spark, d).select("owner", "name", "file_path", "start_line", "end_line", "point_id", F.col("point_id").alias("rank"))
    checked = citations.verify(citations.extracted(_self_citations(spark, d)), hits, ["owner", "name"])
    return checked.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("points"))


def unverified_citations(spark: SparkSession, d: str) -> DataFrame:
    return citations.unverified(citation_check(spark, d))


def refusal_rates(spark: SparkSession, d: str) -> DataFrame:
    answers = T.pairs(spark, d).select("category", text.is_refusal(F.col("answer"), REFUSAL_MARKERS).alias("refused"))
    return evaluate.refusal_rates(answers)


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Before: the readable files as first read. After: those that the last scan could read, with line ends made uniform."""
    before = T.file_texts(spark, d)
    readable = T.scanned_files(spark, d).where("size_bytes IS NOT NULL").select("file_id")
    arrived = T.scanned_files(spark, d).where("arrived_at > scanned_at + INTERVAL 1 DAY").select("file_id")
    after = before.join(readable, "file_id", "left_semi").withColumn("content", F.regexp_replace("content", "\r\n", "\n"))
    return before.join(arrived, "file_id", "left_anti"), after


def snapshot_difference(spark: SparkSession, d: str) -> DataFrame:
    before, after = _snapshots(spark, d)
    return incremental.difference(incremental.snapshot(before), incremental.snapshot(after))


def reindex_summary(spark: SparkSession, d: str) -> DataFrame:
    return incremental.summary(snapshot_difference(spark, d))


def reindexed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Line windows of the files that changed."""
    before, after = _snapshots(spark, d)
    diff = incremental.difference(incremental.snapshot(before), incremental.snapshot(after))
    fresh = incremental.to_index(diff, after).select("owner", "name", F.col("path").alias("file_path"), "content")
    return line_chunks.line_windows(fresh).groupBy("owner", "name").agg(F.count("*").alias("windows"), F.countDistinct("file_path").alias("files"))


def kept_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks that stay after stale ones are taken out."""
    return incremental.without_stale(T.chunks(spark, d), snapshot_difference(spark, d)).select("point_id")


def module_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.suffix_index(T.file_texts(spark, d))


def script_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = T.file_texts(spark, d).where(text.file_extension(F.col("path")).isin(".js", ".ts", ".tsx"))
    return rows.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(graph.SCRIPT_IMPORT), F.lit(1)))).alias("raw"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_edges(T.file_texts(spark, d))


def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a repository in which every module imports the one after it and every script the one after it in its folder: the stored files' paths, with texts that resolve."""
    files = T.file_texts(spark, d).select("owner", "name", "path").distinct()
    python = files.where(F.col("path").endswith(".py"))
    after = F.lead("path").over(Window.partitionBy("owner", "name").orderBy("path"))
    python = python.withColumn("next", after).withColumn("content", F.concat(F.lit("import "), F.replace(graph.module_key(F.col("next")), F.lit("/"), F.lit(".")), F.lit("\n")))
    scripts = files.where(text.file_extension(F.col("path")).isin(".js", ".ts", ".tsx")).withColumn("folder", F.regexp_extract("path", "^(.*/)?[^/]*$", 1))
    after = F.lead("path").over(Window.partitionBy("owner", "name", "folder").orderBy("path"))
    stem = F.regexp_extract("next", r"([^/]*)\.[^./]*$", 1)
    scripts = scripts.withColumn("next", after).withColumn("content", F.concat(F.lit("import x from './"), stem, F.lit("'\n")))
    columns = ["owner", "name", "path", "content"]
    return graph.dependency_edges(python.select(columns).unionByName(scripts.select(columns)))


def python_imports(spark: SparkSession, d: str) -> DataFrame:
    return graph.python_imports(T.file_texts(spark, d)).groupBy("level", "module").agg(F.count("*").alias("files"))


def dependency_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_nodes(_selected(spark, d))


def _located(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "point_id").join(T.chunks(spark, d).select("point_id", "file_path"), "point_id")


def _variants(spark: SparkSession, d: str, questions: Questions = T.eval_questions) -> DataFrame:
    v, k = _pools(spark, d, questions)
    q = questions(spark, d)
    pool = settle(fusion.fuse(v, k, LIMITS.pool))
    first = lambda h: h.where("rank <= 10")
    hits = {"semantic": first(v), "keyword": first(k), "hybrid": first(pool), "hybrid_rerank": fusion.rerank(pool, q, T.chunks(spark, d), 10)}
    out = None
    for variant, h in hits.items():
        part = evaluate.first_correct(evaluate.ranked_files(_located(spark, d, h)), q).withColumn("variant", F.lit(variant))
        out = part if out is None else out.unionByName(part)
    return out


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ranking_metrics(_variants(spark, d), "variant")


def retrieval_by_category(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ranking_metrics(_variants(spark, d), "variant", "category")


def _misses(spark: SparkSession, d: str, questions: Questions) -> DataFrame:
    files = evaluate.ranked_files(_located(spark, d, _keyword(spark, d, 10, questions)))
    return evaluate.misses(evaluate.first_correct(files, questions(spark, d)), files).withColumn("files", F.array_join("files", " "))


def best_variant(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_variant(retrieval_metrics(spark, d))


def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 1 by category, the variants side by side."""
    return evaluate.side_by_side(retrieval_by_category(spark, d), ["semantic", "keyword", "hybrid", "hybrid_rerank"])


def keyword_misses(spark: SparkSession, d: str) -> DataFrame:
    return _misses(spark, d, T.eval_questions)


def retrieval_metrics_all(spark: SparkSession, d: str) -> DataFrame:
    """Over every labelled question; retrieval_metrics keeps to the question set of its SQL."""
    return evaluate.ranking_metrics(_variants(spark, d, T.all_questions), "variant")


def retrieval_by_category_all(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ranking_metrics(_variants(spark, d, T.all_questions), "variant", "category")


def keyword_misses_all(spark: SparkSession, d: str) -> DataFrame:
    return _misses(spark, d, T.all_questions)


def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    hits = _keyword(spark, d, 5).select("query_id", "rank", "point_id").join(T.chunks(spark, d).select("point_id", "file_path", "start_line", "end_line", "symbol_type", "symbol_name", "content"), "point_id")
    return prompts.prompts(T.eval_questions(spark, d).select("query_id", "query"), hits).select("query_id", F.length("prompt").cast("bigint").alias("n"), F.md5("prompt").alias("digest"))


def reference_listing(spark: SparkSession, d: str) -> DataFrame:
    hits = _keyword(spark, d, 10).select("query_id", "rank", "point_id").join(T.chunks(spark, d).select("point_id", "file_path", "start_line", "end_line", "symbol_type", "symbol_name"), "point_id")
    return prompts.listing(hits)


def formatted_hits(spark: SparkSession, d: str) -> DataFrame:
    """Three hits as a tool gives them to a model; every other question asks for what no chunk holds."""
    q = T.eval_questions(spark, d).select("query_id", F.when(F.col("query_id") % 40 == 0, F.lit("qqqqzzzz")).otherwise(F.col("query")).alias("query"))
    hits = _index(spark, d).keyword(q, 3).select("query_id", "rank", "point_id").join(T.chunks(spark, d).select("point_id", "file_path", "start_line", "end_line", "symbol_type", "symbol_name", "content"), "point_id")
    return prompts.formatted(q, hits).select("query_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


def test_files(spark: SparkSession, d: str) -> DataFrame:
    """Tests among the hybrid pool, best five of a query: the cut comes after the filter."""
    pool = _located(spark, d, _hybrid(spark, d, LIMITS.pool)).where(F.contains(F.lower("file_path"), F.lit("test")))
    return bm25.top(pool.withColumn("score", -F.col("rank")).drop("rank"), 5).select("query_id", "rank", "point_id")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first citation of each file over all stored answers."""
    cited = citations.extracted(T.pairs(spark, d).where("owner IS NOT NULL AND name IS NOT NULL").select("id", "owner", "name", "answer"))
    return prompts.first_evidence(cited, ["owner", "name", "file_path"], ["id", "position"]).select("owner", "name", "file_path", "id", "start_line", "end_line")


def repository_references(spark: SparkSession, d: str) -> DataFrame:
    ref = addresses.parse_address(F.col("url"))
    return T.table(spark, d, "repositories").select("owner", "name", addresses.normal_address(F.col("url")).alias("address"), ref.getField("owner").alias("parsed_owner"), ref.getField("name").alias("parsed_name"))


_MESSAGES = ["fatal: Could not resolve host: x", "Failed to connect to y", "fatal: Authentication failed", "could not read Username", "ERROR: Repository not found.", "repository does not exist", "disk full", "429 slow down", "RESOURCE_EXHAUSTED", "503 busy", "UNAVAILABLE", "404 NOT_FOUND", "401", "PERMISSION denied", ""]


def failure_statuses(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m in _MESSAGES], "message string")
    m = F.col("message")
    return rows.select("message", addresses.clone_failure_status(m).alias("clone_status"), addresses.service_failure_status(m).alias("service_status"), addresses.retriable(m).alias("retriable"), addresses.clone_failure_message(m).alias("clone_message"), addresses.service_failure_message(m).alias("service_message"))


def rate_limit_replay(spark: SparkSession, d: str) -> DataFrame:
    """Ten calls an hour for each user."""
    log = replay.rate_limit(T.table(spark, d, "events").dropDuplicates(["event_id"]), "user_id", LIMITS.rate_calls, 3600.0)
    return log.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("allowed")).alias("allowed"))


def calls_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Per event, calls of its user in the hour before it, itself included: what a limiter without denial would see."""
    return replay.trailing_calls(T.table(spark, d, "events").dropDuplicates(["event_id"]), "user_id", 3600)


def answer_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Users as requests to a cache of 64 answers for each event type."""
    e = T.table(spark, d, "events").dropDuplicates(["event_id"])
    log = e.select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("second"), F.col("user_id").cast("string").alias("request"))
    return replay.cache_hits(log, "event_type").groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(F.col("hit")).alias("hits"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_selection, scan_skip_reasons, scan_totals, count_by_extension, count_by_directory, largest_files, secret_files, line_counts, line_windows, symbol_chunking, chunk_totals,
        count_by_symbol_type, chunk_previews, token_counts, document_frequency, inverse_frequency, bm25_search, vector_topk, embedding_buckets, semantic_search, hybrid_search, reranked_search,
        citation_check, citation_containment, unverified_citations, refusal_rates, snapshot_difference, reindex_summary, reindexed_windows, kept_chunks, module_index, script_imports, import_edges, resolved_imports,
        python_imports, dependency_nodes, retrieval_metrics, retrieval_by_category, best_variant, retrieval_report, keyword_misses, retrieval_metrics_all, retrieval_by_category_all, keyword_misses_all, answer_prompts, reference_listing, formatted_hits, test_files, evidence, repository_references, failure_statuses,
        rate_limit_replay, calls_in_window, answer_cache_replay,
    )
}
