"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _pointed(pairs: DataFrame, u, v) -> DataFrame:
    return pairs.select(F.col(u).alias("u"), F.col(v).alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v of one orderable type): root is the least node it is joined to.

    Alternating large-star and small-star rounds, each a pre-aggregated minimum and a join; edges never grow
    in number and the rounds with them are few. Every round is written to the checkpoint folder, so lost
    executors cost one round. The minima of the large-star step are written too: a join of two plain shuffles is one that Spark can
    split where a node is the hub of a large star. Self-loops and repeated edges do no harm; without edges the result is empty.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = e.union(_pointed(e, "v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(_pointed(down, "u", "m"))
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
