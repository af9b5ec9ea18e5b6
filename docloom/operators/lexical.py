"""Lexical search: tokens, inverted index, BM25 for a whole set of queries at a time."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import STOPS, language, words
from .stem import stem_all


def tokenize(text: Column, lang: Column | None = None, stopwords: bool = False, stemming: bool = False, ngrams: tuple[int, int] = (1, 1)) -> Column:
    """Lower-case words; by ``lang`` without stop words and stemmed; then n-grams of ``ngrams`` lengths.

    Without a language, or in one without a list, there are no stop words and stems, as for queries by default.
    """
    out = words(text)
    if lang is not None:
        name = language(lang)
        if stopwords:
            for full, listed in STOPS.items():
                stops = F.array(*[F.lit(w) for w in listed])
                out = F.when(name == full, _without(out, stops)).otherwise(out)
        if stemming:
            out = stem_all(out, F.coalesce(name, F.lit("")))
    low, high = ngrams
    if (low, high) == (1, 1):
        return out
    return F.get(F.transform(F.array(out), lambda ts: F.concat(*[_grams(ts, n) for n in range(low, high + 1)])), F.lit(0))


def _without(tokens: Column, stops: Column) -> Column:
    return F.filter(tokens, lambda w: ~F.array_contains(stops, w))


def _grams(ts: Column, n: int) -> Column:
    starts = F.when(F.size(ts) >= n, F.sequence(F.lit(1), F.size(ts) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ts, i, F.lit(n)), " "))


def postings(docs: DataFrame, tokens: Column, id_col: str = "doc_id", only: set[str] | None = None) -> DataFrame:
    """(term, id, dl, tf): the inverted index; ``dl`` is the length of the document, so scoring needs no second join.

    Terms are counted within each row, so nothing is shuffled. Of ``only``, a set of terms of checked size, no other postings are made.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, term, tf, dl = [], [], [], []
                for k, ts in enumerate(part.column(1).to_pylist()):
                    counts = Counter(ts or ())
                    if wanted is not None:
                        counts = {t: n for t, n in counts.items() if t in wanted}
                    row += [k] * len(counts)
                    dl += [len(ts or ())] * len(counts)
                    term += counts.keys()
                    tf += counts.values()
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), part.column(0).take(pa.array(row, pa.int64())), pa.array(dl, pa.int32()), pa.array(tf, pa.int64())], names=["term", "id", "dl", "tf"])

    return docs.select(F.col(id_col).alias("id"), tokens.alias("ts")).mapInArrow(run, f"term string, id {kind}, dl int, tf long")


def rebuilt(points: DataFrame, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The inverted index and corpus figures of the payloads of a vector collection; blank texts are passed over."""
    rows = points.where(F.trim(F.coalesce(text_col, F.lit(""))) != "")
    tokens = tokenize(F.col(text_col))
    return postings(rows, tokens, id_col), corpus(rows, tokens)


def corpus(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents and their mean length, 1 if that is 0."""
    size = F.size(tokens)
    return docs.agg(F.count("*").alias("n"), F.avg(size).alias("mean")).select("n", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("avgdl"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 0.0, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): BM25 of every query against every document with one of its terms.

    ``queries`` (query_id, ts array<string>); ``delta`` above 0 gives BM25+. Document frequencies and lengths are
    of the whole index, also where ``allowed`` (id) narrows what is scored. The index is joined on terms, so only
    postings of query terms are read on; the terms of the queries are broadcast by Spark while they are small.
    """
    asked = queries.select("query_id", F.explode("ts").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    terms = asked.join(df, "term").crossJoin(F.broadcast(stats))
    terms = terms.select("query_id", "term", "qf", "avgdl", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = index if allowed is None else index.join(allowed.select("id"), "id", "left_semi")
    hits = hits.join(terms, "term")
    tf, dl = F.col("tf"), F.greatest("dl", F.lit(1))
    base = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * (base + delta) * F.col("qf")), 6).alias("score"))


def with_matched(ranked: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """``ranked`` (query_id, id) with ``matched``: the query's terms in the document and how often. Asked of what is left after ranking only."""
    terms = queries.select("query_id", F.explode(F.array_distinct("ts")).alias("term"))
    found = index.join(ranked.select("query_id", "id").join(terms, "query_id"), ["id", "term"])
    matched = F.sort_array(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))))
    return ranked.join(found.groupBy("query_id", "id").agg(matched.alias("matched")), ["query_id", "id"])


def top(scored: DataFrame, k: int, threshold: float = 0.0, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """The ``k`` (1 at least) best of each query at or above ``threshold``, with ``rank``; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), id_col))
    return scored.where(F.col("score") >= threshold).withColumn("rank", rank).where(F.col("rank") <= max(k, 1))


def index_stats(index: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: documents, distinct terms and mean length."""
    return index.agg(F.count_distinct("term").alias("terms")).crossJoin(F.broadcast(stats)).select(F.col("n").alias("documents"), "terms", "avgdl")


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the documents of ``gone`` (id)."""
    return index.join(gone.select("id"), "id", "left_anti")


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the documents of ``new`` in place of any of the same id."""
    return remove(index, new.select("id").distinct()).unionByName(new)


def save(index: DataFrame, stats: DataFrame, path: str) -> None:
    """Writes the index with its terms in order, so that a term's postings are few row groups."""
    index.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/corpus")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus")


_SPAN = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("term", StringType())]))


@F.pandas_udf(_SPAN)
def highlights(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """Where words that begin with one of the terms stand: (start, end, term) in order, each place once."""

    def find(text: str | None, wanted) -> list[dict]:
        spans: dict[tuple[int, int], str] = {}
        for term in wanted if wanted is not None else []:
            if term.strip():
                for m in re.finditer(rf"\b{re.escape(term.strip())}\w*\b", text or "", re.IGNORECASE):
                    spans.setdefault(m.span(), term.strip())
        return [{"start": a, "end": b, "term": t} for (a, b), t in sorted(spans.items())]

    return pd.Series([find(x, t) for x, t in zip(texts, terms, strict=True)])
