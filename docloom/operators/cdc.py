"""Change detection, registries and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(current: DataFrame, known: DataFrame) -> DataFrame:
    """(change_type, id): what is added to, modified in and removed from ``known``; both are (id, hash). Equal rows give nothing."""
    both = current.select("id", F.col("hash").alias("new")).join(known.select("id", F.col("hash").alias("old")), "id", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select(kind.alias("change_type"), "id").where("change_type is not null")


def two_phase(listing: DataFrame, known: DataFrame, read: DataFrame) -> DataFrame:
    """Like changes, but only files whose size or time differ from ``known`` (id, hash, size, modified) are hashed, from ``read`` (id, content)."""
    moved = listing.join(known.select("id", F.col("size").alias("s0"), F.col("modified").alias("m0"), "hash"), "id", "left")
    same = F.coalesce((F.col("size") == F.col("s0")) & (F.col("modified") == F.col("m0")), F.lit(False))
    hashed = read.join(moved.where(~same).select("id"), "id", "left_semi").select("id", F.sha2("content", 256).alias("hash"))
    return changes(moved.where(same).select("id", "hash").unionByName(hashed), known)


def apply_registry(registry: DataFrame, upserts: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The registry with ``upserts`` in place and without ``removed``; a missing source id is "default"."""
    gone = removed.select(key).union(upserts.select(key)).distinct()
    out = registry.join(gone, key, "left_anti").unionByName(upserts.select(registry.columns))
    return out.withColumn("source_id", F.coalesce("source_id", F.lit("default"))) if "source_id" in registry.columns else out


def next_version(history: DataFrame) -> DataFrame:
    """One row: the version behind the highest v<number> of ``history``, v1 at first."""
    top = F.max(F.regexp_extract("version", r"^v(\d+)$", 1).try_cast("int"))
    return history.agg(F.concat(F.lit("v"), (F.coalesce(top, F.lit(0)) + 1).cast("string")).alias("version"))


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The requests (key) that the cache does not have."""
    return requests.join(cache.select("key"), "key", "left_anti")


def get_or_embed(texts: DataFrame, cache: DataFrame, model: str, embed) -> DataFrame:
    """(key, vector) of every distinct text, from the cache where it is there, else by ``embed`` (DataFrame of key and text to key and vector)."""
    keyed = texts.select(F.sha2(F.concat(F.lit(f"{model}::"), F.col("text")), 256).alias("key"), "text").dropDuplicates(["key"])
    hits = keyed.join(cache, "key").select("key", "vector")
    return hits.unionByName(embed(cache_misses(keyed, cache)).select("key", "vector"))


def with_overrides(docs: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with the values of ``overrides`` where it has any."""
    new = overrides.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = docs.join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).select(docs.columns)
