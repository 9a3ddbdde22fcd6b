"""The queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from ..config import EXTENSIONS, IGNORED_DIRECTORIES, REFUSAL_MARKERS, SECRET_PATTERNS
from ..operators.graph import SCRIPT_IMPORT


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_SECRET = "|".join(f"(?:{p})" for p in SECRET_PATTERNS)
_EXTENSION = r"lower(regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '[^.].*?(\.[^.]+)$', 1))"
_FILES = "fr AS (SELECT file_id, any_value(owner) AS owner, any_value(name) AS name, any_value(path) AS path, max(content) AS content FROM files_raw GROUP BY file_id)"
_SCANNED = "sc AS (SELECT * FROM scanned_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC, arrived_at DESC) = 1)"
_CHUNKS = r"""ch AS (SELECT * EXCLUDE (start_line, end_line),
  coalesce(try_cast(regexp_extract(chunk_id, ':(\d+)-(\d+)$', 1) AS INTEGER), start_line) AS start_line, coalesce(try_cast(regexp_extract(chunk_id, ':(\d+)-(\d+)$', 2) AS INTEGER), end_line) AS end_line
  FROM chunks QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY indexed_at) = 1)"""
_PAIRS = "pr AS (SELECT * FROM hallucination_result QUALIFY row_number() OVER (PARTITION BY id ORDER BY answered_at) = 1)"


def _tokens(text: str) -> str:
    split = r"string_split(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '_')"
    parts = f"list_filter(list_transform({split}, lambda p: lower(p)), lambda p: p <> '' AND p <> lower(x))"
    return f"flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda x: list_concat([lower(x)], {parts})))"


_SELECTION = f"""{_FILES}, {_SCANNED},
sel AS (SELECT sc.file_id, sc.owner, sc.name, sc.path, {_EXTENSION.format('sc.path')} AS extension, sc.size_bytes, sc.lines,
  CASE WHEN len(list_intersect(list_slice(string_split(sc.path, '/'), 1, len(string_split(sc.path, '/')) - 1), [{_list(IGNORED_DIRECTORIES)}])) > 0 THEN 'uretilmis_klasor'
       WHEN {_EXTENSION.format('sc.path')} NOT IN ({_list(EXTENSIONS)}) THEN 'desteklenmeyen_uzanti'
       WHEN sc.size_bytes IS NULL THEN 'okunamadi'
       WHEN sc.size_bytes > 1000000 THEN 'cok_buyuk'
       WHEN fr.content IS NULL OR contains(fr.content, chr(0)) THEN 'binary_veya_bozuk'
       WHEN regexp_matches(fr.content, '{_SECRET}') THEN 'sir_iceriyor' END AS skip_reason
  FROM sc LEFT JOIN fr USING (file_id))"""

_TOKENIZED = f"{_CHUNKS}, tk AS (SELECT point_id, {_tokens('concat_ws(chr(32), file_path, content, symbol_name, symbol_name, symbol_name)')} AS tokens FROM ch)"
_IDF = f"""{_TOKENIZED}, st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tk),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM tk) GROUP BY term),
rw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw)"""
_QUESTIONS = "qs AS (SELECT item_id AS query_id, question AS query, category, expected_files FROM eval_items WHERE item_id % 20 = 0)"
_BM25 = f"""{_IDF}, {_QUESTIONS},
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_tokens('query')}) AS term FROM qs) GROUP BY ALL),
tf AS (SELECT point_id, dl, term, count(*) AS tf FROM (SELECT point_id, len(tokens) AS dl, unnest(tokens) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
kw AS (SELECT query_id, point_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term), st GROUP BY query_id, point_id),
kr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank, point_id, score FROM kw WHERE score > 0)"""
_VECTORS = f"""qb AS (SELECT query_id, b, count(*) AS n FROM (SELECT query_id, ('0x' || substr(md5(unnest({_tokens('query')})), 1, 6))::bigint % 64 AS b FROM qs) GROUP BY ALL),
db AS (SELECT point_id, b, count(*) AS n FROM (SELECT point_id, ('0x' || substr(md5(unnest({_tokens('content')})), 1, 6))::bigint % 64 AS b FROM ch) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM qb GROUP BY ALL), dn AS (SELECT point_id, sqrt(sum(n * n)) AS norm FROM db GROUP BY ALL),
dots AS (SELECT query_id, point_id, sum(qb.n * db.n) AS dot FROM qb JOIN db USING (b) GROUP BY ALL),
vw AS (SELECT qn.query_id, dn.point_id, round(coalesce(dot, 0) / (qn.norm * dn.norm), 5) AS score FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.point_id = dn.point_id),
vr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank, point_id, score FROM vw)"""
_HYBRID = f"""{_BM25}, {_VECTORS},
fu AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.point_id, k.point_id) AS point_id, v.rank AS vector_rank, k.rank AS keyword_rank,
  round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + k.rank), 0), 6) AS score
  FROM (SELECT * FROM vr WHERE rank <= 20) v FULL JOIN (SELECT * FROM kr WHERE rank <= 20) k ON v.query_id = k.query_id AND v.point_id = k.point_id),
hy AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(coalesce(vector_rank, 21), coalesce(keyword_rank, 21)), point_id) AS rank, point_id, score, vector_rank, keyword_rank FROM fu)"""
_RERANKED = f"""{_HYBRID},
rs AS (SELECT hy.query_id, hy.point_id, hy.score, round(CASE WHEN len({_tokens('query')}) = 0 THEN 0 ELSE
    len(list_intersect(list_distinct({_tokens('query')}), list_distinct({_tokens("file_path || coalesce(' - ' || symbol_name, '') || chr(10) || substr(content, 1, 2000)")}))) / len(list_distinct({_tokens('query')})) END, 6) AS rerank_score
  FROM hy JOIN qs USING (query_id) JOIN ch USING (point_id) WHERE hy.rank <= 20),
rr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, point_id) AS rank, point_id, score, rerank_score FROM rs)"""

_CITED = r"""cr AS (SELECT *, list_distinct(regexp_extract_all(answer, '[A-Za-z0-9_][\w./-]*\.\w+:\d+-\d+')) AS u, regexp_extract_all(answer, '[A-Za-z0-9_][\w./-]*\.\w+:\d+-\d+') AS r FROM an),
ct AS (SELECT id, owner, name, c, min(p) AS p FROM (SELECT id, owner, name, unnest(r) AS c, generate_subscripts(r, 1) AS p FROM cr) GROUP BY ALL),
cited AS (SELECT id, owner, name, (row_number() OVER (PARTITION BY id ORDER BY p) - 1)::INTEGER AS position, regexp_extract(c, '^(.*):(\d+)-(\d+)$', 1) AS file_path,
  regexp_extract(c, '^(.*):(\d+)-(\d+)$', 2)::INTEGER AS start_line, regexp_extract(c, '^(.*):(\d+)-(\d+)$', 3)::INTEGER AS end_line FROM ct),
vf AS (SELECT d.id, d.position, d.owner, d.name, d.file_path, d.start_line, d.end_line, min(h.point_id) AS point_id
  FROM cited d LEFT JOIN ch h ON h.owner = d.owner AND h.name = d.name AND h.file_path = d.file_path AND d.start_line <= d.end_line AND h.start_line <= d.start_line AND d.end_line <= h.end_line GROUP BY ALL),
checked AS (SELECT vf.*, CASE WHEN point_id IS NOT NULL THEN 'verified' WHEN EXISTS (SELECT 1 FROM ch WHERE ch.owner = vf.owner AND ch.name = vf.name AND ch.file_path = vf.file_path) THEN 'out_of_range' ELSE 'unknown_file' END AS status FROM vf)"""
_ANSWERS = f"{_CHUNKS}, {_PAIRS}, an AS (SELECT id, owner, name, answer FROM pr), {_CITED}"
_SELF = (
    _CHUNKS
    + """, an AS (SELECT point_id AS id, owner, name, concat_ws(' ', file_path || ':' || start_line || '-' || end_line, file_path || ':' || start_line || '-' || ((start_line + end_line) // 2), file_path || ':' || start_line || '-' || (end_line + 100000)) AS answer
  FROM ch WHERE start_line IS NOT NULL AND end_line IS NOT NULL), """
    + _CITED
)
_DIFF = f"""{_FILES}, {_SCANNED},
b AS (SELECT owner, name, path, max(sha1(content)) AS h FROM fr WHERE content IS NOT NULL AND file_id NOT IN (SELECT file_id FROM sc WHERE arrived_at > scanned_at + INTERVAL 1 DAY) GROUP BY ALL),
a AS (SELECT owner, name, path, max(sha1(replace(content, chr(13) || chr(10), chr(10)))) AS h FROM fr WHERE content IS NOT NULL AND file_id IN (SELECT file_id FROM sc WHERE size_bytes IS NOT NULL) GROUP BY ALL),
di AS (SELECT coalesce(b.owner, a.owner) AS owner, coalesce(b.name, a.name) AS name, coalesce(b.path, a.path) AS path,
  CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'deleted' WHEN b.h <> a.h THEN 'modified' ELSE 'unchanged' END AS change
  FROM b FULL JOIN a ON b.owner = a.owner AND b.name = a.name AND b.path = a.path)"""


def _windows(source: str, keys: str) -> str:
    return rf"""ln AS (SELECT {keys}, CASE WHEN content = '' THEN [] WHEN content LIKE '%' || chr(10) THEN list_slice(l, 1, len(l) - 1) ELSE l END AS l
  FROM (SELECT {keys}, replace(content, chr(13) || chr(10), chr(10)) AS content, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {source} WHERE content IS NOT NULL)),
wd AS (SELECT {keys}, l, len(l) AS n, unnest(range(0, (ceil(greatest(len(l) - 120, 0) / 100.0) * 100)::BIGINT + 1, 100)) AS s FROM ln WHERE len(l) > 0),
win AS (SELECT {keys}, s + 1 AS start_line, least(s + 120, n) AS end_line, array_to_string(list_slice(l, s + 1, s + 120), chr(10)) AS content FROM wd)"""


def _correct(hits: str, limit: int = 10) -> str:
    return f"""SELECT qs.query_id, qs.category, min(f.fr) AS correct FROM qs LEFT JOIN (
  SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), file_path) AS fr FROM {hits} JOIN ch USING (point_id) WHERE rank <= {limit} GROUP BY query_id, file_path) f
  ON f.query_id = qs.query_id AND list_contains(qs.expected_files, f.file_path) GROUP BY qs.query_id, qs.category"""


_METRICS = f"""{_RERANKED}, co AS (
SELECT 'semantic' AS variant, * FROM ({_correct('vr')}) UNION ALL SELECT 'keyword', * FROM ({_correct('kr')}) UNION ALL SELECT 'hybrid', * FROM ({_correct('hy')}) UNION ALL SELECT 'hybrid_rerank', * FROM ({_correct('rr')}))"""
_MEASURES = ", ".join([*(f"round(avg(CASE WHEN correct <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in (1, 3, 5)), "round(avg(coalesce(1 / correct, 0)), 6) AS mrr"])
_PLACE = "file_path || ':' || start_line || '-' || end_line || CASE WHEN symbol_name IS NOT NULL AND symbol_name <> '' THEN ' (' || coalesce(symbol_type, 'symbol') || ' ' || symbol_name || ')' ELSE '' END"
_ADDRESS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '^https://', ''), '^http://', ''), '^www\.', ''), '/$', ''), '\.git$', '')"
_OWNER_NAME = r"^github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)/([A-Za-z0-9._-]{1,100})$"
_SCRIPT_FILES = f"{_FILES}, js AS (SELECT * FROM fr WHERE {_EXTENSION.format('path')} IN ('.js', '.ts', '.tsx'))"

ORACLE = {
    "scan_selection": f"WITH {_SELECTION} SELECT file_id, extension, skip_reason FROM sel",
    "scan_skip_reasons": f"WITH {_SELECTION} SELECT skip_reason, count(*) AS n FROM sel GROUP BY skip_reason",
    "scan_totals": f"WITH {_SELECTION} SELECT count(*) AS total_tracked, count(*) FILTER (skip_reason IS NULL) AS selected, count(*) FILTER (skip_reason IS NOT NULL) AS skipped, coalesce(sum(lines) FILTER (skip_reason IS NULL), 0)::BIGINT AS total_lines FROM sel",
    "count_by_extension": f"WITH {_SELECTION} SELECT extension, count(*) AS n FROM sel WHERE skip_reason IS NULL GROUP BY extension",
    "count_by_directory": f"WITH {_SELECTION} SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(kok)' END AS directory, count(*) AS n FROM sel WHERE skip_reason IS NULL GROUP BY 1",
    "largest_files": f"WITH {_SELECTION} SELECT file_id, path, lines FROM sel WHERE skip_reason IS NULL ORDER BY lines DESC NULLS LAST, path, file_id LIMIT 5",
    "secret_files": f"WITH {_FILES} SELECT file_id FROM fr WHERE regexp_matches(content, '{_SECRET}')",
    "line_counts": f"WITH {_FILES} SELECT file_id, (CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN content LIKE '%' || chr(10) THEN 0 ELSE 1 END END)::BIGINT AS n, sha1(content) AS sha1 FROM fr WHERE content IS NOT NULL",
    "line_windows": rf"WITH {_FILES}, {_windows('fr', 'file_id')} SELECT file_id, start_line, end_line, md5(content) AS digest FROM win WHERE regexp_matches(content, '\S')",
    "chunk_totals": f"WITH {_CHUNKS} SELECT count(*) AS chunks, coalesce(sum(end_line - start_line + 1), 0)::BIGINT AS total_lines, coalesce(round(avg(end_line - start_line + 1), 1), 0) AS average_lines, count(DISTINCT (owner, name, file_path)) AS files FROM ch",
    "count_by_symbol_type": f"WITH {_CHUNKS} SELECT symbol_type, count(*) AS n FROM ch WHERE symbol_type IS NOT NULL GROUP BY symbol_type",
    "chunk_previews": f"WITH {_CHUNKS} SELECT point_id, end_line - start_line + 1 AS line_count, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview, md5(file_path || coalesce(' - ' || symbol_name, '') || chr(10) || substr(content, 1, 2000)) AS rerank_digest FROM ch",
    "token_counts": f"WITH {_TOKENIZED} SELECT point_id, len(tokens)::BIGINT AS n, len(list_distinct(tokens))::BIGINT AS distinct_n, md5(array_to_string(tokens, ' ')) AS digest FROM tk",
    "document_frequency": f"WITH {_IDF} SELECT term, df FROM df",
    "inverse_frequency": f"WITH {_IDF} SELECT term, round(idf, 6) AS idf FROM idf",
    "bm25_search": f"WITH {_BM25} SELECT query_id, rank::INTEGER AS rank, point_id, score FROM kr WHERE rank <= 10",
    "vector_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY vec_id) = 1),
s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 5) AS score FROM e q, e d WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "embedding_buckets": f"WITH {_CHUNKS}, {_QUESTIONS}, {_VECTORS} SELECT point_id, b::INTEGER AS bucket, n FROM db",
    "semantic_search": f"WITH {_CHUNKS}, {_QUESTIONS}, {_VECTORS} SELECT query_id, rank::INTEGER AS rank, point_id, score FROM vr WHERE rank <= 10",
    "hybrid_search": f"WITH {_HYBRID} SELECT query_id, rank::INTEGER AS rank, point_id, score, vector_rank::INTEGER AS vector_rank, keyword_rank::INTEGER AS keyword_rank FROM hy WHERE rank <= 10",
    "reranked_search": f"WITH {_RERANKED} SELECT query_id, rank::INTEGER AS rank, point_id, score, rerank_score FROM rr WHERE rank <= 5",
    "citation_check": f"WITH {_ANSWERS} SELECT id, position, file_path, start_line, end_line, status, point_id FROM checked",
    "citation_containment": f"WITH {_SELF} SELECT status, count(*) AS n, count(DISTINCT point_id) AS points FROM checked GROUP BY status",
    "unverified_citations": f"WITH {_ANSWERS} SELECT id, count(*) FILTER (status <> 'verified') AS unverified, count(*) AS citations FROM checked GROUP BY id",
    "refusal_rates": f"""WITH {_PAIRS}, r AS (SELECT category, coalesce(list_bool_or(list_transform([{_list(REFUSAL_MARKERS)}], lambda m: contains(lower(answer), m))), false) AS refused FROM pr)
SELECT category, grouping(category)::INTEGER AS level, count(*) AS questions, count(*) FILTER (refused) AS refused, round(count(*) FILTER (refused) / count(*), 6) AS rate FROM r GROUP BY ROLLUP (category)""",
    "snapshot_difference": f"WITH {_DIFF} SELECT * FROM di",
    "reindex_summary": f"WITH {_DIFF} SELECT owner, name, " + ", ".join(f"count(*) FILTER (change = '{k}') AS {k}" for k in ("added", "modified", "deleted", "unchanged")) + " FROM di GROUP BY owner, name",
    "reindexed_windows": rf"""WITH {_DIFF}, ft AS (SELECT fr.owner, fr.name, fr.path, fr.content FROM fr JOIN di USING (owner, name, path) WHERE change IN ('added', 'modified') AND file_id IN (SELECT file_id FROM sc WHERE size_bytes IS NOT NULL)),
{_windows('ft', 'owner, name, path')} SELECT owner, name, count(*) AS windows, count(DISTINCT path) AS files FROM win WHERE regexp_matches(content, '\S') GROUP BY owner, name""",
    "kept_chunks": f"WITH {_CHUNKS}, {_DIFF} SELECT point_id FROM ch WHERE NOT EXISTS (SELECT 1 FROM di WHERE di.owner = ch.owner AND di.name = ch.name AND di.path = ch.file_path AND change IN ('modified', 'deleted'))",
    "module_index": rf"""WITH {_FILES}, m AS (SELECT owner, name, path, string_split(regexp_replace(path, '(?:/__init__)?\.py$', ''), '/') AS parts FROM fr WHERE path LIKE '%.py' AND path <> '__init__.py'),
s AS (SELECT owner, name, path, parts, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS i FROM m)
SELECT owner, name, array_to_string(list_slice(parts, i, n), '/') AS key, arg_min(path, (n, path)) AS path FROM s GROUP BY 1, 2, 3""",
    "script_imports": f"WITH {_SCRIPT_FILES} SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '{SCRIPT_IMPORT.replace(chr(39), chr(39) * 2)}', 1)) AS raw FROM js",
    "dependency_nodes": f"WITH {_SELECTION} SELECT DISTINCT owner, name, path FROM sel WHERE skip_reason IS NULL",
    "retrieval_metrics": f"WITH {_METRICS} SELECT variant, count(*) AS questions, {_MEASURES} FROM co GROUP BY variant",
    "retrieval_by_category": f"WITH {_METRICS} SELECT variant, category, count(*) AS questions, {_MEASURES} FROM co GROUP BY variant, category",
    "answer_prompts": f"""WITH {_BM25}, x AS (SELECT query_id, string_agg('--- Excerpt ' || rank || ': ' || {_PLACE} || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS e FROM kr JOIN ch USING (point_id) WHERE rank <= 5 GROUP BY query_id),
p AS (SELECT query_id, 'Code excerpts from the repository:' || chr(10) || chr(10) || coalesce(e, '(no excerpts found)') || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM qs LEFT JOIN x USING (query_id))
SELECT query_id, length(prompt)::BIGINT AS n, md5(prompt) AS digest FROM p""",
    "reference_listing": f"WITH {_BM25} SELECT query_id, string_agg({_PLACE}, chr(10) ORDER BY rank) AS listing FROM kr JOIN ch USING (point_id) WHERE rank <= 10 GROUP BY query_id",
    "test_files": f"WITH {_HYBRID} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hy.rank, point_id)::INTEGER AS rank, point_id FROM hy JOIN ch USING (point_id) WHERE hy.rank <= 20 AND contains(lower(file_path), 'test') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hy.rank, point_id) <= 5",
    "evidence": f"WITH {_ANSWERS} SELECT owner, name, file_path, id, start_line, end_line FROM cited WHERE owner IS NOT NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner, name, file_path ORDER BY id, position) = 1",
    "repository_references": f"""WITH r AS (SELECT owner, name, {_ADDRESS} AS address FROM repositories), p AS (SELECT *, regexp_extract(address, '{_OWNER_NAME}', 1) AS o, regexp_extract(address, '{_OWNER_NAME}', 2) AS n FROM r)
SELECT owner, name, address, CASE WHEN o <> '' AND n NOT IN ('.', '..') THEN o END AS parsed_owner, CASE WHEN o <> '' AND n NOT IN ('.', '..') THEN n END AS parsed_name FROM p""",
    "failure_statuses": """WITH m(message) AS (VALUES ('fatal: Could not resolve host: x'), ('Failed to connect to y'), ('fatal: Authentication failed'), ('could not read Username'), ('ERROR: Repository not found.'), ('repository does not exist'), ('disk full'), ('429 slow down'), ('RESOURCE_EXHAUSTED'), ('503 busy'), ('UNAVAILABLE'), ('404 NOT_FOUND'), ('401'), ('PERMISSION denied'), (''))
SELECT message, CASE WHEN contains(lower(message), 'could not resolve host') OR contains(lower(message), 'failed to connect') THEN 502 WHEN contains(lower(message), 'authentication failed') OR contains(lower(message), 'could not read username') THEN 403
 WHEN contains(lower(message), 'not found') OR contains(lower(message), 'repository does not exist') THEN 404 ELSE 502 END AS clone_status,
 CASE WHEN regexp_matches(message, '429|RESOURCE_EXHAUSTED') THEN 429 WHEN regexp_matches(message, '503|UNAVAILABLE') THEN 503 ELSE 502 END AS service_status, regexp_matches(message, '503|UNAVAILABLE|429|RESOURCE_EXHAUSTED') AS retriable,
 CASE WHEN contains(lower(message), 'could not resolve host') OR contains(lower(message), 'failed to connect') THEN 'the host cannot be reached' WHEN contains(lower(message), 'authentication failed') OR contains(lower(message), 'could not read username') THEN 'the repository is private or its address needs a login'
 WHEN contains(lower(message), 'not found') OR contains(lower(message), 'repository does not exist') THEN 'there is no such repository' ELSE 'the repository could not be cloned' END AS clone_message,
 CASE WHEN regexp_matches(message, '429|RESOURCE_EXHAUSTED') THEN 'over the request limit; wait a minute and ask again' WHEN regexp_matches(message, '503|UNAVAILABLE') THEN 'the model is busy; try again in a few seconds'
 WHEN regexp_matches(message, '404|NOT_FOUND') THEN 'there is no model of that name; check the settings' WHEN regexp_matches(message, '401|403|PERMISSION') THEN 'the key was refused; check the settings' ELSE 'no answer was made; try again later' END AS service_message FROM m""",
    "calls_in_window": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS s FROM events QUALIFY row_number() OVER (PARTITION BY event_id) = 1)
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM e""",
    "best_variant": f"WITH {_METRICS}, me AS (SELECT variant, {_MEASURES} FROM co GROUP BY variant) SELECT variant, mrr FROM me ORDER BY mrr DESC, variant DESC LIMIT 1",
    "retrieval_report": f"WITH {_METRICS} SELECT category, " + ", ".join(f"round(avg(CASE WHEN correct <= 1 THEN 1.0 ELSE 0.0 END) FILTER (variant = '{v}'), 6) AS {v}" for v in ("semantic", "keyword", "hybrid", "hybrid_rerank")) + " FROM co GROUP BY category",
    "keyword_misses": f"""WITH {_BM25}, co AS ({_correct('kr')}), rf AS (
SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), file_path) AS fr FROM kr JOIN ch USING (point_id) WHERE rank <= 10 GROUP BY query_id, file_path),
b AS (SELECT query_id, string_agg(file_path, ' ' ORDER BY fr) AS files FROM rf WHERE fr <= 3 GROUP BY query_id)
SELECT co.query_id, category, correct::INTEGER AS correct, files FROM co LEFT JOIN b USING (query_id) WHERE correct IS NULL OR correct <> 1""",
    "formatted_hits": f"""WITH {_BM25.replace("question AS query", "CASE WHEN item_id % 40 = 0 THEN 'qqqqzzzz' ELSE question END AS query")},
x AS (SELECT query_id, string_agg('--- ' || {_PLACE} || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS t FROM kr JOIN ch USING (point_id) WHERE rank <= 3 GROUP BY query_id),
p AS (SELECT query_id, coalesce(t, 'No results.') AS t FROM qs LEFT JOIN x USING (query_id))
SELECT query_id, length(t)::BIGINT AS n, md5(t) AS digest FROM p""",
    "resolved_imports": rf"""WITH {_FILES}, f AS (SELECT DISTINCT owner, name, path FROM fr),
mo AS (SELECT owner, name, path, regexp_replace(path, '(?:/__init__)?\.py$', '') AS key FROM f WHERE path LIKE '%.py'),
ix AS (SELECT owner, name, array_to_string(list_slice(parts, i, n), '/') AS key, arg_min(path, (n, path)) AS path FROM (
  SELECT owner, name, path, parts, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT owner, name, path, string_split(key, '/') AS parts FROM mo WHERE path <> '__init__.py')) GROUP BY 1, 2, 3),
pn AS (SELECT owner, name, path AS source, lead(key) OVER (PARTITION BY owner, name ORDER BY path) AS key, lead(path) OVER (PARTITION BY owner, name ORDER BY path) AS next FROM mo),
pe AS (SELECT pn.owner, pn.name, source, ix.path AS target FROM pn JOIN ix ON ix.owner = pn.owner AND ix.name = pn.name AND ix.key = pn.key WHERE next <> '__init__.py' AND source <> ix.path
  AND regexp_matches(pn.key, '^[A-Za-z_][A-Za-z0-9_]*(/[A-Za-z_][A-Za-z0-9_]*)*$')),
js AS (SELECT owner, name, path, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS folder FROM f WHERE {_EXTENSION.format('path')} IN ('.js', '.ts', '.tsx')),
jn AS (SELECT owner, name, path AS source, folder || regexp_extract(lead(path) OVER (PARTITION BY owner, name, folder ORDER BY path), '([^/]*)\.[^./]*$', 1) AS base FROM js),
sx(place, suffix) AS (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '/index.ts'), (6, '/index.tsx'), (7, '/index.js'), (8, '/index.jsx')),
known AS (SELECT owner, name, path FROM mo UNION SELECT owner, name, path FROM js),
je AS (SELECT jn.owner, jn.name, source, arg_min(k.path, place) AS target FROM jn CROSS JOIN sx JOIN known k ON k.owner = jn.owner AND k.name = jn.name AND k.path = base || suffix WHERE base IS NOT NULL GROUP BY ALL)
SELECT DISTINCT owner, name, source, target FROM pe UNION ALL SELECT DISTINCT owner, name, source, target FROM je WHERE source <> target""",
    "rate_limit_replay": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events QUALIFY row_number() OVER (PARTITION BY event_id) = 1),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::BIGINT[] AS times, false AS allowed FROM e
  UNION ALL SELECT user_id, i, CASE WHEN len(live) < 10 THEN list_append(live, s) ELSE live END, len(live) < 10 FROM (SELECT e.user_id, e.i, e.s, list_filter(r.times, lambda t: e.s - t < 3600000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, count(*) AS calls, count(*) FILTER (allowed) AS allowed FROM r WHERE i > 0 GROUP BY user_id""",
    "answer_cache_replay": """WITH e AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS i FROM events QUALIFY row_number() OVER (PARTITION BY event_id) = 1),
p AS (SELECT *, lag(i) OVER (PARTITION BY event_type, user_id ORDER BY i) AS before FROM e),
h AS (SELECT p.event_type, p.i, count(DISTINCT o.user_id) AS others FROM p JOIN e o ON o.event_type = p.event_type AND o.i > p.before AND o.i < p.i WHERE p.before IS NOT NULL GROUP BY 1, 2)
SELECT p.event_type, count(*) AS requests, count(*) FILTER (p.before IS NOT NULL AND coalesce(h.others, 0) < 64) AS hits FROM p LEFT JOIN h USING (event_type, i) GROUP BY p.event_type""",
}
# the same over every labelled question
ORACLE |= {f"{k}_all": ORACLE[k].replace(" WHERE item_id % 20 = 0", "") for k in ("retrieval_metrics", "retrieval_by_category", "keyword_misses")}
