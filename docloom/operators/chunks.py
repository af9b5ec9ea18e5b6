"""Chunks of documents as rows, previews and figures about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunking as ch
from ..functions.text import sha256_id, shorten, token_count, tokens


def chunk_documents(docs: DataFrame, config: ch.ChunkConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, chunk_index, content, tokens, chunk_id): a row for each chunk."""
    out = docs.select(id_col, F.posexplode(ch.chunk(F.col(text_col), config)).alias("chunk_index", "c"))
    return out.select(id_col, "chunk_index", "c.content", "c.tokens", sha256_id(F.col(id_col), F.col("chunk_index"), F.col("c.content")).alias("chunk_id"))


def preview(chunks: DataFrame, config: ch.ChunkConfig, id_col: str = "doc_id") -> DataFrame:
    """Chunks with the words that they share with their neighbours and the start of their text."""
    n, along = config.chunk_overlap, Window.partitionBy(id_col).orderBy("chunk_index")

    def shared(before: Column, after: Column) -> Column:
        ts = tokens(before)
        common = F.array_join(F.slice(ts, F.greatest(F.size(ts) - n + 1, F.lit(1)), F.lit(max(n, 1))), " ")
        return F.when((F.lit(n) > 0) & (common != "") & after.contains(common), common)

    out = chunks.withColumn("overlap_before", shared(F.lag("content").over(along), F.col("content"))).withColumn("overlap_after", shared(F.col("content"), F.lead("content").over(along)))
    count = lambda c: token_count(F.coalesce(F.col(c), F.lit("")))
    return out.select("*", count("overlap_before").alias("overlap_before_tokens"), count("overlap_after").alias("overlap_after_tokens"), shorten(F.col("content"), 500, "…").alias("content_truncated"))


def stats(previews: DataFrame) -> DataFrame:
    """One row: number, mean, least, most and median of chunk sizes, and the sum of overlaps."""
    zero = F.lit(0).cast("long")
    t = F.col("tokens")
    return previews.agg(
        F.count("*").alias("total_chunks"),
        F.coalesce(F.bround(F.avg(t), 2), F.lit(0.0)).alias("avg_size_tokens"),
        F.coalesce(F.min(t), zero).alias("min_size_tokens"),
        F.coalesce(F.max(t), zero).alias("max_size_tokens"),
        F.coalesce(F.median(t), F.lit(0.0)).alias("median_size_tokens"),
        F.coalesce(F.sum("overlap_before_tokens"), zero).alias("total_overlap_tokens"),
    ).withColumn("many", F.col("total_chunks") > 200)


def distribution(chunks: DataFrame, width: int = 50) -> DataFrame:
    """(range_start, range_end, count) of chunk sizes, empty ranges included."""
    counts = chunks.groupBy(F.floor(F.col("tokens") / width).alias("bucket")).agg(F.count("*").alias("count"))
    spine = counts.agg(F.max("bucket").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("bucket"))
    out = spine.join(counts, "bucket", "left")
    return out.select((F.col("bucket") * width).alias("range_start"), ((F.col("bucket") + 1) * width).alias("range_end"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
