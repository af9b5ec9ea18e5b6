"""Vectors: hashed embeddings, exact nearest neighbours, collections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import words

#: Queries that are broadcast at most, or meet points in one task; points of a shard.
BLOCK, SHARD = 4096, 65_536
METRICS = ("cosine", "dot", "euclidean")

# Known embedding models and their dimensions.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "embed-multilingual-v3.0": 1024, "voyage-3": 1024, "mistral-embed": 1024, "nomic-embed-text": 768, "all-minilm": 384}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """``v`` at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.get(F.transform(F.array(F.struct(v.cast("array<double>").alias("v"), norm.alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where a vector is zero; an error where dimensions differ."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    value = F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")).cast("double")).otherwise(value)


#: Words whose places a worker remembers, until the memory is full; rows that are laid out at once.
REMEMBERED, ROWS = 200_000, 1000


def hashed_vector(tokens: Column, dimensions: int) -> Column:
    """Each word's share of ``tokens`` at two places that its sha256 names, with signs; the second half as much. Nothing is shuffled.

    A batch's words are numbered once, each different one is hashed at most once by a worker, and places are added up as numbers.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def lay(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, float, int, float]] = {}

        def places(word: str) -> tuple[int, float, int, float]:
            if word not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                h = sha256(word.encode("utf-8", "surrogatepass")).hexdigest()
                sign = lambda at: 1.0 if int(h[at : at + 2], 16) % 2 == 0 else -1.0
                known[word] = (int(h[:16], 16) % dimensions, sign(16), int(h[18:34], 16) % dimensions, 0.5 * sign(34))
            return known[word]

        for batch in batches:
            done = []
            for rows in (batch.slice(i, ROWS) for i in range(0, len(batch), ROWS)):
                size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = rows.flatten().dictionary_encode()
                i, a, j, b = (np.array(x) for x in zip(*map(places, words.dictionary.to_pylist()), strict=True)) if len(words) else (np.zeros(0, np.int64),) * 4
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, n = np.unique(np.repeat(np.arange(len(rows)), size) * max(1, len(i)) + code, return_counts=True)
                row, code = np.divmod(pairs, max(1, len(i)))
                share = n / size[row]
                out = np.bincount(row * dimensions + i[code], a[code] * share, len(rows) * dimensions) + np.bincount(row * dimensions + j[code], b[code] * share, len(rows) * dimensions)
                done.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dimensions, pa.int32()), pa.array(out)))
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.float64()))

    return lay(F.coalesce(tokens, F.array().cast("array<string>")))


def hashed_embedding(docs: DataFrame, dimensions: int, id_col: str = "doc_id", text_col: str = "text", normalize: bool = True) -> DataFrame:
    """(id_col, vector) of each row by hashed_vector of its words; a text without words, or none, has the zero vector."""
    out = docs.select(id_col, hashed_vector(words(F.col(text_col)), dimensions).alias("vector"))
    return out.withColumn("vector", l2_normalize(F.col("vector"))) if normalize else out


def embed(docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]], id_col: str = "doc_id", text_col: str = "text", batch: int = 32) -> DataFrame:
    """(id_col, vector) by any function of a list of texts, ``batch`` at a time."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[list[float]] = []
            for at in range(0, len(frame), batch):
                out += embedder(frame[text_col].iloc[at : at + batch].fillna("").tolist())
            yield pd.DataFrame({id_col: frame[id_col], "vector": out})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, vector array<double>")


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Points by queries, larger is nearer, rounded to 6."""
    s = x @ q.T
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
        s = np.where(norm > 0, np.clip(s / np.where(norm > 0, norm, 1), -1, 1), 0)
    elif metric == "euclidean":
        s = -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * s, 0))
    return np.round(s, 6) + 0.0


def _nearest(vec: np.ndarray, x: np.ndarray, names: np.ndarray, q: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """The ``k`` best points of each query among a batch of points."""
    s = _scores(x, q, metric)
    some, best = min(k, len(x)), []
    last = np.partition(s, len(x) - some, 0)[len(x) - some]
    for j in range(len(q)):  # all that reach the k-th score, so that ties are settled by id
        near = np.flatnonzero(s[:, j] >= last[j])
        best.append(near[np.lexsort((vec[near], -s[near, j]))[:some]])
    best = np.stack(best)
    return pd.DataFrame({"query_id": np.repeat(names, best.shape[1]), "vec_id": vec[best.ravel()], "score": s[best.ravel(), np.repeat(np.arange(len(q)), best.shape[1])]})


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the exact ``k`` nearest points of each query (query_id, vector).

    Up to BLOCK queries are broadcast, and every batch of points meets them as one matrix product, of which
    only the ``k`` best per query go on: points are not shuffled. Of more queries each block meets the points in
    shards, one pair a task. Scores are rounded to 6, ties go to the smaller id. Vectors that are null, hold nulls or do not
    have the dimensions of most queries (the fewer of equally frequent ones) take no part on either side.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark = points.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    rows = points.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(whole("v"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).where(whole("q"))
    sizes = asked.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimensions = sizes["d"] if sizes else 0
    rows, asked = rows.where(F.size("v") == dimensions), asked.where(F.size("q") == dimensions)
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {points.schema[id_col].dataType.simpleString()}, score double"
    few = asked.limit(BLOCK + 1).collect()
    if not few:
        near = spark.createDataFrame([], kind)
    elif len(few) <= BLOCK:
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in few]), np.array([r["q"] for r in few])))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for frame in frames:
                if len(frame):
                    yield _nearest(frame["vec_id"].to_numpy(), np.stack(frame["v"].to_numpy()), names, q, k, metric)

        near = rows.mapInPandas(run, kind)
    else:
        blocks, shards = -(-asked.count() // BLOCK), max(spark.sparkContext.defaultParallelism, -(-rows.count() // SHARD))
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        left = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).select("*", every(blocks, "block"))
        right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select("*", every(shards, "shard"))

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": b["query_id"][:0], "vec_id": a["vec_id"][:0], "score": np.zeros(0)})
            x, q, names = np.stack(a["v"].to_numpy()), np.stack(b["q"].to_numpy()), b["query_id"].to_numpy()
            return pd.concat([_nearest(a["vec_id"].to_numpy(), x, names[at : at + 256], q[at : at + 256], k, metric) for at in range(0, len(q), 256)])

        near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(pair, kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def mmr(candidates: DataFrame, k: int, lam: float = 0.5, partition: str = "query_id") -> DataFrame:
    """(query_id, id, pick): the order of maximal marginal relevance of each query's candidates (id, score, vector).

    The first pick has the best score; each next one the largest ``lam`` * score - (1 - ``lam``) * its nearest pick's
    cosine. Ties go to the better score, then the smaller id. A query's candidates are a page's worth and fit a task.
    """
    kind, ids = (candidates.schema[c].dataType.simpleString() for c in (partition, "id"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"], ascending=[False, True])
        x = np.stack(frame["vector"].to_numpy()).astype(float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        score, near, left, picks = frame["score"].to_numpy(), np.full(len(x), -np.inf), np.ones(len(x), bool), []
        while left.any() and len(picks) < k:
            value = score if not picks else lam * score - (1 - lam) * near
            i = int(np.where(left, value, -np.inf).argmax())
            picks.append(i)
            left[i] = False
            near = np.maximum(near, np.clip(x @ x[i], -1, 1))
        return pd.DataFrame({partition: frame[partition].iloc[0], "id": frame["id"].to_numpy()[picks], "pick": np.arange(1, len(picks) + 1)})

    return candidates.select(partition, "id", "score", F.col("vector").cast("array<double>").alias("vector")).groupBy(partition).applyInPandas(run, f"{partition} {kind}, id {ids}, pick long")


def collection_stats(points: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: vectors, dimensions and bytes of them as doubles."""
    return points.agg(F.count("*").alias("vectors"), F.max(F.size(vector_col)).cast("long").alias("dimensions"), F.sum(F.size(vector_col) * 8).cast("long").alias("bytes"))


def upsert(points: DataFrame, new: DataFrame, id_col: str = "vec_id", order: str | None = None) -> DataFrame:
    """``points`` with ``new`` in place of rows of the same id; of several new rows the last by ``order`` wins.

    Rows of a DataFrame have no order of their own: without ``order``, or where it ties, a hash of the whole row decides, so reruns agree.
    """
    last = [F.desc(order)] if order else []
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(*last, F.xxhash64(*[F.col(c) for c in new.columns]), *[F.to_json(F.struct(*new.columns))]))
    new = new.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return points.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(new.select(points.columns))


def delete_where(points: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return points.join(gone.select(key).distinct(), key, "left_anti")


def check_dimensions(points: DataFrame, dimensions: int, vector_col: str = "embedding") -> DataFrame:
    """``points``; reading a row of other dimensions fails."""
    bad = F.raise_error(F.lit(f"a vector does not have {dimensions} dimensions"))
    return points.withColumn(vector_col, F.when(F.size(vector_col) == dimensions, F.col(vector_col)).otherwise(bad.cast(points.schema[vector_col].dataType)))


