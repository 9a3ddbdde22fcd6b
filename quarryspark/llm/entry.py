"""Queries over the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, generated, leakage, near_duplicates, packing, page_spam, pair_defects, splitting, syntax
from .common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "chunks"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_links(table(spark, sf_dir, "chunks"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.all_files(table(spark, sf_dir, "scanned_files"), table(spark, sf_dir, "files_raw"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.not_handwritten(_scanned(spark, sf_dir)).select("file_id")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generated.not_handwritten(_scanned(spark, sf_dir))
    return found.groupBy("reason").agg(F.count("*").alias("files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(table(spark, sf_dir, "chunks"))


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_spans(table(spark, sf_dir, "chunks")).distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken_files(table(spark, sf_dir, "files_raw")).select("file_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.error_rates(table(spark, sf_dir, "files_raw"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defective_pairs(table(spark, sf_dir, "hallucination_result"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "hallucination_result")
    found = pair_defects.defective_pairs(pairs)
    ids = pairs.where("id IS NOT NULL").groupBy("id").agg(F.max("category").alias("category"))
    joined = ids.join(found, "id", "left")
    return joined.groupBy("category").agg(F.count("*").alias("pairs"), *[F.count_if(F.col("defect") == k).alias(k) for k in ("empty", "truncated", "refusal", "copies_question", "other_language")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks")).where("piece = 0").select("point_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p7_pack_2048(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 2048)


def p7_pack_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 512)


def p7_pack_8192(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 8192)


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.filling(packing.pack(table(spark, sf_dir, "documents"), 2048), 2048)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each leaking document the items and how many words are cut."""
    cut = leakage.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return cut.select("doc_id", F.array_join(F.col("items").cast("array<string>"), " ").alias("items"), F.col("removed_words").cast("bigint").alias("removed_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_spam.spam_pages(table(spark, sf_dir, "documents"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_spam.scores(table(spark, sf_dir, "documents")).select("doc_id", "source", F.round("page_score", 6).alias("page_score"), F.round("host_rate", 6).alias("host_rate"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_reasons, p3_found, p3_spans, p3_redacted, p4_found, p4_rates, p5_found, p5_rates, p6_found, p6_pieces, p7_pack_2048, p7_pack_512, p7_pack_8192, p7_filling, p8_found, p8_decontaminated, p8_removed, p9_found, p9_scores)}

ORACLE = {
    "p1_found": """
WITH c AS (SELECT point_id, any_value(content) AS content FROM chunks WHERE content IS NOT NULL AND point_id IS NOT NULL GROUP BY point_id),
t AS (SELECT point_id, list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM c),
g AS (SELECT point_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 40),
e AS (SELECT point_id, len(s) AS n, unnest(s) AS gram FROM g),
p AS (SELECT a.point_id AS point_id_a, b.point_id AS point_id_b, a.n AS na, b.n AS nb, count(*) AS k
      FROM e a JOIN e b ON a.gram = b.gram AND a.point_id < b.point_id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY ALL)
SELECT point_id_a, point_id_b FROM p WHERE 10 * k >= 7 * (na + nb - k)""",
    "p1_links": """
WITH c AS (SELECT point_id, any_value(content) AS content FROM chunks WHERE content IS NOT NULL AND point_id IS NOT NULL GROUP BY point_id),
t AS (SELECT point_id, content, list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM c),
k AS (SELECT content, min(point_id) AS class_id, count(*) AS copies, any_value(w) AS w FROM t WHERE len(w) >= 40 GROUP BY content),
g AS (SELECT class_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM k),
e AS (SELECT class_id, len(s) AS n, unnest(s) AS gram FROM g),
p AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS k
      FROM e a JOIN e b ON a.gram = b.gram AND a.class_id < b.class_id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT class_id, count(*) AS links FROM (SELECT unnest([a, b]) AS class_id FROM p WHERE 10 * k >= 7 * (na + nb - k)) GROUP BY class_id)
SELECT t.point_id, k.class_id, k.copies, coalesce(l.links, 0) AS links FROM t JOIN k USING (content) LEFT JOIN l USING (class_id) WHERE len(t.w) >= 40""",
    "p6_found": """
SELECT DISTINCT point_id FROM chunks
WHERE point_id IS NOT NULL AND (length(content) > 8000 OR length(content) - length(replace(content, chr(10), '')) + 1 > 150)""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(passage, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE passage IS NOT NULL AND item_id IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS gram FROM d WHERE len(w) >= 13),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS gram FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)""",
    "p8_removed": r"""
WITH d AS (SELECT doc_id, any_value(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x))) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
i AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(passage, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE passage IS NOT NULL AND item_id IS NOT NULL),
dg AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS gram FROM i WHERE len(w) >= 13),
m AS (SELECT doc_id, item_id, k FROM dg JOIN ig USING (gram)),
n AS (SELECT doc_id, count(DISTINCT word) AS removed_words FROM (SELECT doc_id, unnest(range(k, k + 13)) AS word FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(item_id, ' ' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, items, removed_words FROM s JOIN n USING (doc_id)""",
}
