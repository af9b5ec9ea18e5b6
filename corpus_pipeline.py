"""The corpus pipeline: documents to token ids in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, line_dedup, mixing, quality, simhash
from docloom.llm.common import read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (see quality.annotate); the field is fitted on the labels of ``sf_dir``.

    Null and empty texts have too few words and go; rows that repeat an id are judged one by one; without labels only
    the base rule decides. All columns stay as they are, whatever their names; no rows give none.
    """
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with others (see line_dedup.dedup_lines); n_chars follows the text.

    No document goes. A null text becomes empty; rows without an id lose nothing; rows that repeat an id count as one document. All
    other columns stay as they are, whatever their names; no rows give none.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("__rest")
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", rest))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[made.get(c, F.col(f"__rest.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of SimHash near duplicates: candidates within 13 bits whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more (see simhash.similar_documents).

    Texts without words are one group; rows that repeat the kept id all stay; a document without an id stays only in a group without any
    id. All columns stay as they are, whatever their names; no rows give none.
    """
    return simhash.dedup(docs, similarity=simhash.SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice (see mixing.mix).

    Texts without words weigh nothing; rows without a source are one source; equal rows are taken alike. All columns stay
    as they are, whatever their names; no rows give none.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each row (see bpe.encode); a null or empty text has no ids, and every row stays."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary())
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: The field, the groups of near copies and the entropy balancing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
