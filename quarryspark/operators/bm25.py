"""BM25 over an inverted index, many queries in one plan.

``search`` reads chunks without an index; ``search_postings`` reads stored postings, only those of the queries' terms.

Corpus statistics come from one pass with map-side combine, settled once; postings are cut to the query terms before they are shuffled.
A term in more than half of the documents has a negative raw idf and gets epsilon times the average over the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import code_token_bag, code_tokens, index_text
from ..sources.checkpoints import settle


def tokenized(chunks: DataFrame) -> DataFrame:
    """(point_id, tokens), in no order: path, content and the weighted symbol name."""
    return chunks.select("point_id", code_token_bag(index_text(F.col("file_path"), F.col("content"), F.col("symbol_name"))).alias("tokens"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    # explode_outer: a plain explode makes the optimizer filter on the size of the array, which tokenises every text twice
    return tokens.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: documents n, average length avgdl."""
    return tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def raw_idf(n, df):
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def inverse_frequency(df: DataFrame, stats: DataFrame, epsilon: float = LIMITS.bm25_epsilon) -> DataFrame:
    """(term, df, idf)."""
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", raw_idf(F.col("n"), F.col("df")))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def top(scored: DataFrame, limit: int, key: str = "query_id") -> DataFrame:
    """Rank from 1 by score (to six places), ties by point_id; per partition first, so no query's hits meet unreduced."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "point_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def vocabulary(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document frequency, corpus statistics) of one pass over the texts: a null term stands for every document and carries its length."""
    # the length is a column before the explode, so exploded rows do not carry the array
    sized = tokens.select(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string"))).alias("terms"), F.size("tokens").alias("dl"))
    marked = sized.select("dl", F.explode_outer("terms").alias("term"))
    counted = settle(marked.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length")))
    stats = counted.where("term IS NULL").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    return counted.where("term IS NOT NULL").select("term", "df"), stats


def search(chunks: DataFrame, queries: DataFrame, limit: int = 5, k1: float = LIMITS.bm25_k1, b: float = LIMITS.bm25_b) -> DataFrame:
    """(query_id, rank, point_id, score) for queries(query_id, query). Repeated query terms count again; scores of 0 or less are no hits.

    A query without a token has no hits. The query side is broadcast if it is under Spark's own size threshold, else shuffled.
    """
    tokens = tokenized(chunks)
    terms = queries.select("query_id", F.explode(code_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = terms.select("term").distinct()
    frequency, stats = vocabulary(tokens)
    idf = inverse_frequency(frequency, stats)
    sized = tokens.select("point_id", "tokens", F.size("tokens").alias("dl"))
    tf = sized.select("point_id", "dl", F.explode_outer("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("point_id", "term", "dl").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = terms.join(idf, "term")
    scored = tf.join(weighted, "term").crossJoin(F.broadcast(stats.select("avgdl"))).groupBy("query_id", "point_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored.where("score > 0"), limit).select("query_id", "rank", "point_id", "score")


def posting_rows(tokens: DataFrame) -> DataFrame:
    """(term, point_id, tf, dl); a term is its 64-bit hash, smaller than the word and quick to sort (two of a billion words share one with a probability of three in a hundred); a null term stands for the document itself, so one without a token counts too.

    Counted inside each document's sorted keys, where every run of one key ends at the place where the next begins: no shuffle.
    """
    bag = tokens.select("point_id", F.size("tokens").alias("dl"), F.sort_array(F.transform("tokens", lambda t: F.xxhash64(t))).alias("t"))
    starts = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == 1) | (F.element_at("t", i) != F.element_at("t", F.greatest(i - 1, F.lit(1)))))
    begun = bag.select("point_id", "dl", "t", F.when(F.col("dl") > 0, starts).otherwise(F.array().cast("array<int>")).alias("s"))
    runs = F.zip_with("s", F.concat(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), F.array(F.col("dl") + 1)), lambda a, b: F.when(a.isNotNull(), F.struct(F.element_at("t", a).alias("term"), (b - a).alias("tf"))))
    own = F.array(F.struct(F.lit(None).cast("bigint").alias("term"), F.lit(1).alias("tf")))
    return begun.select("point_id", "dl", F.explode_outer(F.concat(F.filter(runs, lambda r: r.isNotNull()), own)).alias("r")).select("r.term", "point_id", "r.tf", "dl")


#: Distinct query terms up to which a search names them in its filters; beyond, they are joined.
NAMED_TERMS = 2000


def search_postings(postings: DataFrame, terms: DataFrame, stats: tuple[int, float, float], queries: DataFrame, limit: int = 5, parts: int = 1, k1: float = LIMITS.bm25_k1, b: float = LIMITS.bm25_b) -> DataFrame:
    """The rows of ``search`` from stored postings(term, point_id, tf, dl, part), terms(term, df) and (documents, average length, mean raw idf)."""
    n, avgdl, mean = stats
    spark = postings.sparkSession
    asked = queries.select("query_id", F.explode(F.transform(code_tokens(F.col("query")), lambda t: F.xxhash64(t))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    rows = asked.limit(4 * NAMED_TERMS + 1).collect()
    named = sorted({r.term for r in rows})
    if len(rows) <= 4 * NAMED_TERMS and len(named) <= NAMED_TERMS:
        asked = spark.createDataFrame([(r.query_id, r.term, r.times) for r in rows], asked.schema)
        postings = postings.where(F.col("term").isin(named) & F.col("part").isin(sorted({t % parts for t in named})))
        terms = terms.where(F.col("term").isin(named))
    else:
        postings = postings.join(asked.select("term").distinct(), "term", "left_semi")
    raw = raw_idf(F.lit(n), F.col("df"))
    weighted = asked.join(terms.select("term", F.when(raw < 0, LIMITS.bm25_epsilon * mean).otherwise(raw).alias("idf")), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    scored = postings.select("term", "point_id", "tf", "dl").join(weighted, "term").groupBy("query_id", "point_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored.where("score > 0"), limit).select("query_id", "rank", "point_id", "score")
