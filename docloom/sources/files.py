"""Files as sources: listing, text of the formats that need no library, tree of folders."""

from __future__ import annotations

import json
import re
import zipfile
from fnmatch import translate
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import extension, sha256_id
from . import pdf

ENCODINGS = ("utf-8", "utf-16", "cp1252", "latin-1")
TEXT_TYPES = ("md", "txt", "html", "csv", "rst", "xml", "json", "yaml")
SUPPORTED = ("pdf", "docx", "doc", *TEXT_TYPES)


def list_files(spark: SparkSession, root: str, recursive: bool = True, types: tuple[str, ...] | None = SUPPORTED, excluded_dirs: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_bytes: int | None = None) -> DataFrame:
    """(path, rel, name, ext, size, modified, content) of the files below ``root``, by Spark's binary reader.

    Office lock files (~$), folders of ``excluded_dirs`` (any letter case) and names or relative paths that fit a pattern
    of ``exclude`` are passed over; ``types`` None takes files of any. Content is read only where it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    base = re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    rel = F.regexp_replace("path", rf"^.*?{base}/", "")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select("path", rel.alias("rel"), name.alias("name"), extension(name).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    rows = rows.where(~F.col("name").startswith("~$"))
    if types is not None:
        rows = rows.where(F.col("ext").isin(*types))
    if max_bytes:
        rows = rows.where(F.col("size") <= max_bytes)
    for folder in excluded_dirs:
        low, own = F.lower("rel"), folder.lower().strip("/")
        rows = rows.where(~(low.startswith(own + "/") | low.contains("/" + own + "/")))
    if exclude:
        pattern = "|".join(translate(p).replace("\\z", "$").replace("\\Z", "$") for p in exclude)
        rows = rows.where(~F.col("name").rlike(pattern) & ~F.col("rel").rlike(pattern))
    return rows


def documents(files: DataFrame, source_id: str) -> DataFrame:
    """The files as source rows: id of source and path, hash of the bytes."""
    return files.select(sha256_id(F.lit(source_id), F.col("rel")).alias("id"), F.lit(source_id).alias("source_id"), F.col("name").alias("title"), F.col("rel").alias("file_path"), F.col("ext").alias("file_type"), F.col("size").alias("file_size_bytes"), F.col("modified").alias("last_modified"), F.sha2("content", 256).alias("content_hash"))


def decode(raw: bytes) -> tuple[str, str]:
    """The text of a file and the first encoding that reads it."""
    for name in ENCODINGS:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads all bytes")


def docx_text(raw: bytes, tables: bool = True) -> tuple[str, int]:
    """Paragraphs of a .docx file as lines, without those in ``tables`` if not asked for, and its pages at 500 words each."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    inside = set() if tables else {p for t in body.iter(f"{ns}tbl") for p in t.iter(f"{ns}p")}
    text = "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in body.iter(f"{ns}p") if p not in inside)
    return text, max(1, round(len(text.split()) / 500))


def docx_flags(raw: bytes) -> dict[str, bool]:
    """Whether a .docx file has tables and images."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        return {"has_tables": b"<w:tbl>" in (x := z.read("word/document.xml")) or b"<w:tbl " in x, "has_images": any(n.startswith("word/media/") for n in z.namelist())}


def doc_text(raw: bytes) -> str:
    """Printable runs of an old .doc file; "" where it is not one."""
    if not raw.startswith(bytes.fromhex("d0cf11e0a1b11ae1")):
        return ""
    runs = re.findall(rb"(?:[\x20-\x7e\xc0-\xff]\x00){8,}|[\x20-\x7e\xc0-\xff\r\n\t]{8,}", raw)
    parts = [r.decode("utf-16-le", "ignore") if r[1:2] == b"\x00" else r.decode("cp1252", "ignore") for r in runs]
    return "\n".join(p.strip() for p in parts if sum(c.isalpha() or c.isspace() for c in p) > 0.6 * len(p))


def read_one(raw: bytes, ext: str) -> tuple[str, str]:
    if ext == "docx":
        return docx_text(raw)[0], "docx"
    if ext == "doc":
        return doc_text(raw), "doc"
    if ext == "pdf":
        return pdf.read(raw)["text"], "pdf"
    text, encoding = decode(raw)
    if ext == "json":
        text = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    return text, encoding


_PARSED = StructType([StructField("text", StringType()), StructField("encoding", StringType()), StructField("error", StringType())])


@F.pandas_udf(_PARSED)
def parsed(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
    """struct<text, encoding, error> of files; a file that cannot be read has an error and fails nothing else."""
    out = []
    for raw, kind in zip(content, ext, strict=True):
        try:
            text, encoding = read_one(bytes(raw), kind)
            out.append((text, encoding, None))
        except Exception as e:  # any broken file
            out.append((None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["text", "encoding", "error"])


def folder_stats(files: DataFrame) -> DataFrame:
    """(ext, supported, files, size_mb) by number of files, then name."""
    out = files.groupBy("ext").agg(F.count("*").alias("files"), F.bround(F.sum("size") / 1048576, 2).alias("size_mb"))
    return out.withColumn("supported", F.col("ext").isin(*SUPPORTED)).orderBy(F.desc("files"), "ext")


def folder_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(folder, depth, files, size): each folder to ``depth`` with all below it; hidden folders are passed over."""
    parts = F.slice(F.split("rel", "/"), F.lit(1), F.greatest(F.size(F.split("rel", "/")) - 1, F.lit(0)))
    rows = files.select("size", parts.alias("parts")).where(~F.exists("parts", lambda p: p.startswith(".")))
    level = F.explode(F.sequence(F.lit(0), F.least(F.size("parts"), F.lit(depth))))
    rows = rows.select("size", "parts", level.alias("depth")).withColumn("folder", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    return rows.groupBy("folder", "depth").agg(F.count("*").alias("files"), F.sum("size").alias("size"))
