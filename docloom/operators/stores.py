"""Stores of versioned folders, exports and conversations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY = "version string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[str]:
    """The versions below ``path``, oldest first."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((n for n in names if re.fullmatch(r"v\d+", n)), key=lambda n: int(n[1:]))


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the pointers below ``path``, which are the names of empty files."""
    fs, p = _fs(spark, f"{path}/current")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(m[1]), m[2]) for n in names if (m := re.fullmatch(r"(\d+)-(v\d+)", n)))


def current(spark: SparkSession, path: str) -> str | None:
    """The version that the last pointer names."""
    found = _pointers(spark, path)
    return found[-1][1] if found else None


def point(spark: SparkSession, path: str, version: str) -> None:
    """Makes ``version`` the current one: a snapshot is restored by pointing back to it.

    A pointer is a new file, so that a reader always finds one. Two writers that point at once both stay; the greater version counts.
    """
    if version not in versions(spark, path):
        raise ValueError(f"no such version: {version}")
    found = _pointers(spark, path)
    fs, p = _fs(spark, f"{path}/current/{found[-1][0] + 1 if found else 1:012d}-{version}")
    fs.createNewFile(p)


def commit(rows: DataFrame, path: str) -> str:
    """Writes ``rows`` as the next version, never over an old one, and points to it; a number that another writer takes meanwhile is an error."""
    spark = rows.sparkSession
    known = versions(spark, path)
    version = f"v{int(known[-1][1:]) + 1 if known else 1}"
    rows.write.parquet(f"{path}/{version}")
    point(spark, path, version)
    return version


def load(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/{version or current(spark, path)}")


def export_csv(log: DataFrame, path: str, columns: list[str]) -> None:
    """The log as CSV with a header; nested columns as JSON."""
    kinds = dict(log.dtypes)
    out = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in columns]
    log.select(*out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def document_status(title: Column, author: Column, language: Column) -> Column:
    """error for a title that cannot be one, complete with title, author and language, else partial."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    odd = has(title) & (title.rlike("^[^a-zA-Z0-9À-ÿ\"']") | title.rlike("(?i)bjbj"))
    return F.when(odd, "error").when(has(title) & has(author) & has(language), "complete").otherwise("partial")


def search_table(docs: DataFrame, text: str | None, fields: list[str], kind: str | None = None, type_col: str = "file_type") -> DataFrame:
    """The documents with ``text`` in one of ``fields``, any letter case, and of one type."""
    out = docs
    if text:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(f).contains(text.lower()), F.lit(False))
        out = out.where(hit)
    return out.where(F.col(type_col) == kind) if kind else out


def conversations(messages: DataFrame, partition: str = "id") -> DataFrame:
    """Conversations from messages (id, timestamp): first and last time and number."""
    return messages.groupBy(partition).agg(F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"), F.count("*").alias("total_messages"))


def migrate(old: DataFrame, known: DataFrame) -> DataFrame:
    """Conversations of old message files that are not known yet."""
    return conversations(old).join(known.select("id"), "id", "left_anti")


def delete_conversations(store: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations of ``gone`` (id)."""
    return store.join(gone.select("id"), "id", "left_anti"), messages.join(gone.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")


def listed(store: DataFrame) -> DataFrame:
    """Conversations but the default one, last changed first."""
    return store.where("id <> 'default'").orderBy(F.desc("updated_at"), "id")


def conversation_messages(messages: DataFrame, conversation: str) -> DataFrame:
    """The messages (conversation_id, ts, id) of one conversation in their order."""
    return messages.where(F.col("conversation_id") == conversation).orderBy("ts", "id")


def history_rows(messages: DataFrame) -> DataFrame:
    """(conversation_id, history array<struct<role, content>>): the messages of each conversation in order, as a model gets them."""
    one = F.struct("ts", "id", F.col("role"), F.coalesce("content", F.lit("")).alias("content"))
    turns = F.transform(F.sort_array(F.collect_list(one)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return messages.groupBy("conversation_id").agg(turns.alias("history"))
