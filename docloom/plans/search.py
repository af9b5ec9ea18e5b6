"""Searches: lexical, semantic and hybrid, for whole query sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import normalized_score
from ..operators import fusion, lexical, vector
from ..operators.cut import cut


@dataclass(frozen=True)
class SearchConfig:
    """How to search. ``kind``: lexical, semantic or hybrid."""

    kind: str = "hybrid"
    top_k: int = 10
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.0
    metric: str = "cosine"
    prefetch: int = 3
    threshold: float = 0.0
    mmr_lambda: float | None = None
    method: str = "rrf"
    alpha: float = 0.5
    rrf_k: int = 60
    normalization: str = "min_max"
    filters: fusion.Filters = field(default_factory=fusion.Filters)


#: Distinct terms of a query set up to which they are broadcast, so that an index built for one search holds no others.
MOST_TERMS = 100_000
Index = tuple[DataFrame, DataFrame]


def lexical_search(docs: DataFrame, queries: DataFrame, c: SearchConfig, id_col: str = "doc_id", text_col: str = "text", matched: bool = False, index: Index | None = None) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, text); with ``matched`` also the terms found.

    ``index`` is an inverted index with the corpus figures (see lexical.load); without one the texts are indexed for this search alone.
    Ids of queries that are texts are numbered while the sums of queries and documents are made, which are many rows.
    """
    if isinstance(queries.schema["query_id"].dataType, StringType):
        named = cut(queries.select("query_id").distinct().withColumn("_number", F.monotonically_increasing_id()))
        numbered = queries.withColumnRenamed("query_id", "_name").join(named, F.col("_name").eqNullSafe(F.col("query_id"))).select(F.col("_number").alias("query_id"), "text")
        out = lexical_search(docs, numbered, c, id_col, text_col, matched, index)
        rest = [x for x in out.columns if x != "query_id"]
        return out.withColumnRenamed("query_id", "_number").join(named, "_number").select("query_id", *rest)
    asked = queries.select("query_id", lexical.tokenize(F.col("text")).alias("ts"))
    tokens, stored = lexical.tokenize(F.col(text_col)), index is not None
    if index is None:
        terms = [r[0] for r in asked.select(F.explode("ts")).distinct().limit(MOST_TERMS + 1).collect()]
        index = lexical.postings(docs, tokens, id_col, set(terms) if len(terms) <= MOST_TERMS else None), lexical.corpus(docs, tokens)
    found, stats = index
    allowed = docs.where(c.filters.predicate()).select(F.col(id_col).alias("id")) if c.filters != fusion.Filters() else None
    best = lexical.top(lexical.bm25(found, stats, asked, c.k1, c.b, c.delta, allowed), c.top_k, c.threshold)
    if not matched:
        return best
    best = cut(best)
    if not stored:  # of the texts that were found alone
        found = lexical.postings(docs.join(best.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi"), tokens, id_col)
    return lexical.with_matched(best, found, asked)


def semantic_search(points: DataFrame, queries: DataFrame, c: SearchConfig, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, raw, score, rank) for queries (query_id, vector): prefetch, threshold, filter, then MMR or the first.

    The filter comes behind the prefetch, so fewer than ``top_k`` can be left; ``score`` is (raw + 1) / 2 in 0..1.
    """
    near = vector.knn(points, queries, c.top_k * c.prefetch, c.metric, id_col, vector_col).select("query_id", F.col("vec_id").alias("id"), F.col("score").alias("raw"))
    near = near.withColumn("score", F.round(normalized_score(F.col("raw")), 4)).where(F.col("score") >= c.threshold)
    if c.filters != fusion.Filters():
        near = near.join(points.where(c.filters.predicate()).select(F.col(id_col).alias("id")), "id", "left_semi")
    if c.mmr_lambda is not None:
        found = near.join(points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "id")
        picks = vector.mmr(found.select("query_id", "id", F.col("raw").alias("score"), "vector"), c.top_k, c.mmr_lambda)
        return near.join(picks, ["query_id", "id"]).withColumn("rank", F.col("pick").cast("int")).select("query_id", "id", "raw", "score", "rank")
    ranked = lexical.top(near.withColumnRenamed("score", "__s").withColumnRenamed("raw", "score"), c.top_k, float("-inf"))
    return ranked.select("query_id", "id", F.col("score").alias("raw"), F.col("__s").alias("score"), "rank")


def funnel(points: DataFrame, queries: DataFrame, c: SearchConfig, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, prefetched, above_threshold, filtered): how many results each step of a semantic search leaves."""
    near = vector.knn(points, queries, c.top_k * c.prefetch, c.metric, id_col, vector_col).withColumn("s", F.round(normalized_score(F.col("score")), 4))
    near = near.join(points.select(F.col(id_col).alias("vec_id"), c.filters.predicate().alias("fits")), "vec_id")
    ok = F.col("s") >= c.threshold
    return near.groupBy("query_id").agg(F.count("*").alias("prefetched"), F.count_if(ok).alias("above_threshold"), F.count_if(ok & F.col("fits")).alias("filtered"))


def search(docs: DataFrame, queries: DataFrame, c: SearchConfig, dimensions: int = 128, index: Index | None = None, points: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank, ...) over ``docs`` (doc_id, text, ...) by the kind of ``c``, with hashed embeddings.

    ``index`` and ``points`` (id, vector) are what a collection has stored of ``docs``; without them the texts are indexed for this search alone.
    """
    if c.kind == "lexical":
        return lexical_search(docs, queries, c, index=index)
    if points is None:
        points = vector.hashed_embedding(docs, dimensions).withColumnRenamed("doc_id", "id")
    asked = vector.hashed_embedding(queries, dimensions, "query_id")
    if c.kind == "semantic":
        return semantic_search(points, asked, c)
    wide = SearchConfig(**{**c.__dict__, "top_k": fusion.candidates_per_side(c.top_k, c.top_k, c.top_k), "prefetch": 1, "mmr_lambda": None})
    return fusion.fuse(semantic_search(points, asked, wide).select("query_id", "id", "score"), lexical_search(docs, queries, wide, index=index).select("query_id", "id", "score"), c.method, c.alpha, c.rrf_k, c.normalization, c.threshold, c.top_k)
