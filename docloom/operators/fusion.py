"""Filters, fusion of two rankings, reranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


@dataclass(frozen=True)
class Filters:
    """Values that a row must have one of, by field; an empty list asks nothing."""

    doc_ids: list = field(default_factory=list)
    doc_types: list = field(default_factory=list)
    languages: list = field(default_factory=list)
    categories: list = field(default_factory=list)

    FIELDS = (("doc_ids", "doc_id"), ("doc_types", "doc_type"), ("languages", "language"), ("categories", "category"))

    def merge(self, other: Filters | None) -> Filters:
        """Values in both where both ask, in the order of ``other``; else those of the one that asks."""
        if other is None:
            return self

        def one(a: list, b: list) -> list:
            return [x for x in b if x in a] if a and b else b or a

        return Filters(*[one(getattr(self, n), getattr(other, n)) for n, _ in self.FIELDS])

    def predicate(self, **columns: str) -> Column:
        """All fields fit; null fits nothing that is asked."""
        out = F.lit(True)
        for name, default in self.FIELDS:
            if values := getattr(self, name):
                out = out & F.coalesce(F.col(columns.get(name, default)).isin(*values), F.lit(False))
        return out


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value")


def _normalized(scores: DataFrame, method: str) -> Column:
    w = Window.partitionBy("query_id")
    s = F.col("score")
    if method == "min_max":
        low, high = F.min(s).over(w), F.max(s).over(w)
        return F.when(high - low < 1e-10, 0.5).otherwise((s - low) / F.nullif(high - low, F.lit(0.0)))
    std = F.stddev_pop(s).over(w)
    return F.when(std < 1e-10, 0.0).otherwise((s - F.avg(s).over(w)) / F.nullif(std, F.lit(0.0)))


def fuse(semantic: DataFrame, lexical: DataFrame, method: str = "rrf", alpha: float = 0.5, k: int = 60, normalization: str | None = "min_max", threshold: float = 0.0, top_k: int = 10, deduplicate: bool = True) -> DataFrame:
    """One ranking of two, each (query_id, id, score): reciprocal ranks or weighted scores.

    Returns query_id, id, score, the ranks, scores and contributions of both sides, and rank. An id that a side
    misses gets 0 from it. Scores are rounded to 6 before they are compared; ties go to the smaller id. Without ``deduplicate`` an
    id that both sides found comes twice.
    """

    def side(rows: DataFrame, name: str, weight: float) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        part = 1.0 / (k + F.col(f"{name}_rank")) if method == "rrf" else (_normalized(rows, normalization) if normalization else F.col("score"))
        return rows.select("query_id", "id", "score").withColumn(f"{name}_rank", place).withColumn(f"{name}_contribution", weight * part).withColumnRenamed("score", f"{name}_score")

    both = side(semantic, "semantic", alpha).join(side(lexical, "lexical", 1 - alpha), ["query_id", "id"], "full_outer")
    zero = F.lit(0.0)
    both = both.withColumn("score", F.round(F.coalesce("semantic_contribution", zero) + F.coalesce("lexical_contribution", zero), 6))
    if not deduplicate:
        both = both.unionByName(both.where("semantic_rank is not null and lexical_rank is not null"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return both.where(F.col("score") >= threshold).withColumn("rank", rank).where(F.col("rank") <= max(top_k, 1))


def candidates_per_side(required: int, semantic_k: int, lexical_k: int, most: int = 100) -> int:
    """How many rows each side is asked for."""
    return min(max(2 * required, semantic_k, lexical_k), most)


def token_overlap(query: Column, text: Column) -> Column:
    """Part of the query's distinct words that the text has: the reranker that needs no model."""
    q = F.array_distinct(words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(words(text)))) / F.size(q)).otherwise(0.0)


def rerank(results: DataFrame, scorer: Column, candidates: int = 40, threshold: float = 0.0, top_n: int = 10) -> DataFrame:
    """The first ``candidates`` of each query (query_id, id, rank, score) in the order of ``scorer``, clipped to 0..1 (null: 0).

    Adds rerank_score, original_rank, new rank and rank_change (places gained).
    """
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scorer, F.lit(0.0))))
    rows = results.where(F.col("rank") <= min(candidates, 100)).withColumn("rerank_score", F.round(score, 6)).where(F.col("rerank_score") >= threshold)
    new = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "id"))
    rows = rows.withColumn("new_rank", new).where(F.col("new_rank") <= top_n)
    return rows.withColumn("rank_change", F.col("rank") - F.col("new_rank")).withColumnRenamed("rank", "original_rank").withColumnRenamed("new_rank", "rank")


def final_score(rerank_score: str = "rerank_score", score: str = "score") -> Column:
    """The rerank score, or the score where there is none or it is 0."""
    return F.coalesce(F.nullif(F.col(rerank_score), F.lit(0.0)), F.col(score))


def merge_queries(results: DataFrame, group: str = "query_id", id_col: str = "id") -> DataFrame:
    """Results of rewritten queries of one ``group`` as one list: the best score of each id, rows without an id last."""
    best = F.row_number().over(Window.partitionBy(group, id_col).orderBy(F.desc("score")))
    rows = results.where(F.col(id_col).isNotNull()).withColumn("__n", best).where("__n = 1").drop("__n").unionByName(results.where(F.col(id_col).isNull()))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(id_col).isNull(), F.desc("score"), id_col))
    return rows.withColumn("rank", rank)


def distinct_queries(rewrites: DataFrame) -> DataFrame:
    """Of each query's rewrites (query_id, place, text) the first of those that differ only in letter case."""
    n = F.row_number().over(Window.partitionBy("query_id", F.lower("text")).orderBy("place"))
    return rewrites.withColumn("__n", n).where("__n = 1").drop("__n")
