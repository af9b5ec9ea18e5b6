"""Queries of the ingestion run and of the segmented index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunking import ChunkConfig
from ..operators import lexical
from ..operators.cut import shared_folder
from ..operators.segments import Segments
from ..streaming.ingestion import Ingestion
from .suite import query, table

_LABELLED = """bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), odd AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM bad))"""


@query("w03_ingestion", rf"""WITH {_LABELLED},
one AS (SELECT doc_id::VARCHAR AS id, doc_id, text, min(doc_id::VARCHAR) OVER (PARTITION BY text) = doc_id::VARCHAR AS kept FROM documents),
two AS (SELECT o.id, o.doc_id, o.text || ' Revised.' AS text, min(o.id) OVER (PARTITION BY o.text) = o.id
   AND NOT EXISTS (SELECT 1 FROM one k WHERE k.kept AND k.text = o.text || ' Revised.' AND k.doc_id NOT IN (SELECT doc_id FROM bad UNION ALL SELECT doc_id FROM odd)) AS kept
 FROM one o JOIN odd USING (doc_id)),
live AS (SELECT id, text, kept, 'v1' AS version FROM one WHERE doc_id NOT IN (SELECT doc_id FROM bad UNION ALL SELECT doc_id FROM odd) UNION ALL SELECT id, text, kept, 'v2' FROM two),
w AS (SELECT id, regexp_extract_all(text, '\S+') AS ws FROM live WHERE kept),
k AS (SELECT id, ws, unnest(range(0, len(ws), 64)) AS a FROM w),
c AS (SELECT id, count(*) AS n, sum(least(64, len(ws) - a))::BIGINT AS tokens, sha256(string_agg(array_to_string(ws[a + 1 : a + 64], ' '), '|' ORDER BY a)) AS digest FROM k GROUP BY id)
SELECT l.id AS doc_id, CASE WHEN kept THEN 'done' ELSE 'duplicate' END AS status, version AS ingestion_version, coalesce(n, 0)::INT AS chunk_count, tokens, digest FROM live l LEFT JOIN c USING (id)""")
def w03(spark, d):
    """All documents arrive; then those of bad quality are gone from the listing and the toxic ones have changed."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    bad = labels.where("quality = 0").select("doc_id").distinct()
    odd = labels.where("toxic = 1").select("doc_id").distinct().withColumn("odd", F.lit(True))

    def listing(rows, text):
        content = F.encode(text, "utf-8")
        return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_id"), F.concat_ws("/", "source", "doc_id").alias("path"), F.lit("txt").alias("ext"), content.alias("content"), F.sha2(content, 256).alias("hash"), F.octet_length(content).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"))

    run = Ingestion(spark, shared_folder(spark, "ingestion"), ChunkConfig("fixed_size", 64, 0, 1, preserve_sentences=False), dimensions=64)
    run.run(listing(docs, F.col("text")))
    later = docs.join(bad, "doc_id", "left_anti").join(odd, "doc_id", "left")
    run.run(listing(later, F.when(F.col("odd"), F.concat("text", F.lit(" Revised."))).otherwise(F.col("text"))))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"])
    chunks = run.points().groupBy("doc_id").agg(F.sum("chunk_tokens").alias("tokens"), F.sha2(F.array_join(texts, "|"), 256).alias("digest"))
    return run.registry().join(chunks, "doc_id", "left").select("doc_id", "status", "ingestion_version", "chunk_count", "tokens", "digest")


@query("l06_segments", rf"""WITH {_LABELLED},
tok AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id IN (SELECT doc_id FROM odd) THEN text || ' revised' ELSE text END), '[\p{{L}}\p{{N}}_]+') AS ts FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bad))
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY 1""")
def l06_segments(spark, d):
    """An index of all documents, from which some are removed and in which others are replaced, by segments."""
    docs, labels = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), table(spark, d, "labels")
    store = Segments(spark, shared_folder(spark, "segments"), {"postings": "term string, id string, dl int, tf long, doc_id string"}, fanout=2)

    def add(rows):
        store.commit({"postings": lexical.postings(rows, lexical.tokenize(F.col("text"))).withColumn("doc_id", F.col("id"))}, rows.select("doc_id"))

    bad = labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    odd = labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(bad, "doc_id", "left_anti")
    add(docs)
    store.commit({}, bad)
    add(docs.join(odd, "doc_id").withColumn("text", F.concat("text", F.lit(" revised"))))
    return store.live("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
