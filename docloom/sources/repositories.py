"""Checked-out repositories, buckets and mail as documents, by Spark's binary reader."""

from __future__ import annotations

import re
import subprocess
from email import message_from_bytes, policy
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import extension, sha256_id
from .files import list_files

# Files that tell what a repository is.
README_FILES = ("README", "README.md", "README.rst", "README.txt", "CONTRIBUTING.md", "CHANGELOG.md")


def checkout(url: str, folder: str, branch: str = "main", depth: int = 1) -> str:
    """The checkout of ``url`` in ``folder``, a shared one on a cluster: cloned, or brought to the end of ``branch``. A local path is one already."""
    if Path(url).exists():
        return url

    def git(*args: str) -> None:
        subprocess.run(["git", *args], check=True, capture_output=True)

    if Path(folder, ".git").exists():
        git("-C", folder, "fetch", "--depth", str(depth), "origin", branch)
        git("-C", folder, "checkout", "-B", branch, "FETCH_HEAD")
    else:
        git("clone", "--depth", str(depth), "--branch", branch, "--", url, folder)
    return folder


def repository(spark: SparkSession, path: str, source_id: str, types: tuple[str, ...] = (), readme_only: bool = False, excluded_dirs: tuple[str, ...] = (), max_bytes: int | None = None) -> DataFrame:
    """The text files of a checkout as documents; ``types`` are extensions (all if empty). Nothing below .git is read."""
    files = list_files(spark, path, True, types or None, (".git", *excluded_dirs), (), max_bytes)
    if readme_only:
        files = files.where(F.col("name").isin(*README_FILES))
    text = F.decode("content", "UTF-8")
    return files.select(sha256_id(F.lit(source_id), F.col("rel")).alias("id"), F.lit(source_id).alias("source_id"), F.col("name").alias("title"), text.alias("content"), F.col("rel").alias("file_path"), F.col("ext").alias("file_type"), F.col("size").alias("file_size_bytes"), F.col("modified").alias("last_modified"), F.sha2("content", 256).alias("content_hash"))


def bucket(spark: SparkSession, uri: str, source_id: str, recursive: bool = True, types: tuple[str, ...] = (), max_bytes: int | None = None, with_content: bool = True) -> DataFrame:
    """The objects below ``uri`` (s3a://bucket/prefix, or any path that Spark reads) as documents.

    Size and time are filters that the reader gets; the bytes of an object are read only where content is asked for. Without them the hash
    is that of key, size and time, which is what a listing knows.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(uri)
    if max_bytes:
        rows = rows.where(F.col("length") <= max_bytes)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = rows.withColumn("name", name).withColumn("ext", extension(name))
    if types:
        rows = rows.where(F.col("ext").isin(*types))
    seen: Column = F.sha2("content", 256) if with_content else F.sha2(F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256)
    out = rows.select(sha256_id(F.lit(source_id), F.col("path")).alias("id"), F.lit(source_id).alias("source_id"), F.col("name").alias("title"), F.col("path").alias("url"), F.col("ext").alias("file_type"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("last_modified"), seen.alias("content_hash"), *([F.col("content")] if with_content else []))
    return out


_MAIL = StructType([StructField(n, StringType()) for n in ("message_id", "subject", "sender", "sent", "body", "error")])


@F.pandas_udf(_MAIL)
def mail_parts(raw: pd.Series) -> pd.DataFrame:
    """struct<message_id, subject, sender, sent, body, error> of messages as they come from a mailbox; the plain part is the body, or the HTML part without its tags."""
    out = []
    for data in raw:
        try:
            m = message_from_bytes(bytes(data), policy=policy.default)
            part = m.get_body(("plain", "html"))
            body = part.get_content() if part is not None else ""
            if part is not None and part.get_content_type() == "text/html":
                body = re.sub(r"<[^>]*>", " ", body)
            sent = m["date"].datetime.isoformat() if m["date"] is not None and m["date"].datetime else None
            out.append((str(m["message-id"] or "").strip() or None, str(m["subject"] or ""), str(m["from"] or ""), sent, "\n".join(line.rstrip() for line in body.strip().splitlines()), None))
        except Exception as e:  # any broken message
            out.append((None, None, None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=_MAIL.names)


def mailbox(messages: DataFrame, source_id: str, raw: str = "content") -> DataFrame:
    """Messages (raw bytes) as documents; the id is of the message's own, or of its bytes where it has none."""
    rows = messages.select(mail_parts(F.col(raw)).alias("m"), F.sha2(raw, 256).alias("content_hash"))
    key = F.coalesce("m.message_id", "content_hash")
    return rows.select(sha256_id(F.lit(source_id), key).alias("id"), F.lit(source_id).alias("source_id"), F.col("m.subject").alias("title"), F.col("m.body").alias("content"), F.col("m.sender").alias("author"), F.col("m.sent").alias("last_modified"), "content_hash", F.col("m.error").alias("error"))
