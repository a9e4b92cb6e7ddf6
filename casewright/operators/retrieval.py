"""Passage retrieval: postings, BM25 and vector similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.columns import search_tokens
from casewright.operators.network import settle

K1, B = 1.5, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf."""
    return docs.select("doc_id", F.explode(search_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, score. Texts are read and cut into tokens once: lengths and the query's tokens are written, and statistics come from all documents
    of the scope."""
    tokens = docs.select("doc_id", search_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    sized = settle(tokens.select("doc_id", F.size("t").alias("len"), F.filter("t", lambda x: x.isin(*terms)).alias("found")))
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))  # one row
    hits = sized.select("doc_id", "len", F.explode("found").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def scoped(docs: DataFrame, wanted: str, columns: tuple[str, ...] = ("source",)) -> DataFrame:
    """Documents whose file name or title holds the wanted text, without case."""
    held = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted.strip().lower()) for c in columns]
    return docs.where(F.array_contains(F.array(*held), True))


def cosine(vectors: DataFrame, query_id: int) -> DataFrame:
    """vec_id, similarity to one of the vectors, unrounded."""
    q = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q"))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return vectors.join(F.broadcast(q)).select("vec_id", (dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q"))).alias("similarity"))


def similarity(vectors: DataFrame, query_id: int) -> DataFrame:
    """Cosine similarity of every vector to one of them."""
    return cosine(vectors, query_id).withColumn("similarity", F.round("similarity", 6))


def hybrid(scored: DataFrame, similar: DataFrame, key: str) -> DataFrame:
    """Mean of the text score over its largest and the similarity scaled to its range. The extremes are one row."""
    both = scored.join(similar, key)
    ends = both.agg(F.max("score").alias("_top"), F.min("similarity").alias("_low"), F.max("similarity").alias("_high"))
    scaled = 0.5 * F.col("score") / F.col("_top") + 0.5 * (F.col("similarity") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return both.join(F.broadcast(ends)).select(key, F.round(scaled, 5).alias("score"))
