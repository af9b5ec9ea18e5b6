"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, read

MIN_CHARS = 20
MIN_DOCS = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text_col``, and the columns n_lines and n_dropped (long).

    Lines are exploded as 128-bit hashes of their normalised form, counted by distinct documents, and
    those in ``min_docs`` documents or more leave every document but the one of the largest id; the
    lines that stay are reassembled by position. Only hashes and ids are shuffled to count; texts move
    once, to meet their own list of hashes to drop.

    A key is the line stripped of ASCII white space with A-Z lower-cased; keys of fewer than
    ``min_chars`` code points never go. A null or empty text is one empty line, and a null text
    comes back empty. A row without an id takes no part in counting and loses nothing. Rows that
    repeat an id count as one document and all lose, or keep, the line. Columns n_lines
    and n_dropped of the input, if any, are replaced; every other column passes through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def keys(of):
        return F.transform(F.split(ascii_lower(of), "\n"), lambda line: F.btrim(line, F.lit(SPACE)))

    def hashed(key):
        return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))

    seen = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(keys(text), hashed))).alias("line"))
        .where(F.col("line").isNotNull())
        .distinct()
    )
    shared = seen.groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    drops = (
        seen.join(shared, "line")
        .where(F.col("id") < F.col("keeper"))
        .groupBy(F.col("id").alias("__id"))
        .agg(F.collect_list("line").alias("__drop"))
    )
    lines, drop = F.split(text, "\n"), F.col("__drop")
    gone = F.transform(keys(text), lambda key: F.coalesce(F.array_contains(drop, hashed(key)), F.lit(False)))
    # zipped, not looked up by position in a lambda: there Spark may put the whole expression of __gone, once a line
    marked = F.zip_with(lines, F.col("__gone"), lambda line, away: F.struct(line.alias("line"), away.alias("away")))
    keeps = F.transform(F.filter(marked, lambda x: ~x["away"]), lambda x: x["line"])
    out = docs.join(drops.hint("shuffle_hash"), F.col(id_col) == F.col("__id"), "left")
    out = out.withColumn("__gone", F.when(drop.isNotNull(), gone))
    stays = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return out.select(
        *stays,
        F.when(drop.isNull(), text).otherwise(F.array_join(keeps, "\n")).alias(text_col),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("__gone", lambda x: x)), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id < s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
