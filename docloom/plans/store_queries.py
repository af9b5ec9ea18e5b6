"""Queries of stores and agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agents, stores
from ..operators.cut import shared_folder
from .suite import query, table


@query("k04_snapshot_restore", "SELECT vec_id, label FROM embeddings")
def k04(spark, d):
    """A version with all labels changed, then back to the first."""
    path = shared_folder(spark, "collection")
    points = table(spark, d, "embeddings").select("vec_id", "label")
    first = stores.commit(points, path)
    stores.commit(points.withColumn("label", F.lit(-1)), path)
    stores.point(spark, path, first)
    return stores.load(spark, path)


@query("k05_index_round_trip", r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM documents)
SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS term FROM tok) GROUP BY 1""")
def k05(spark, d):
    from ..operators import lexical

    docs, ts, path = table(spark, d, "documents"), lexical.tokenize(F.col("text")), shared_folder(spark, "bm25")
    lexical.save(lexical.postings(docs, ts), lexical.corpus(docs, ts), path)
    return lexical.load(spark, path)[0].groupBy("term").agg(F.count("*").alias("df"))


@query("k13_csv_export", "SELECT event_id::VARCHAR AS event_id, event_type, props FROM events")
def k13(spark, d):
    path = shared_folder(spark, "export")
    stores.export_csv(table(spark, d, "events"), path, ["event_id", "event_type", "props"])
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("k16_conversations", "SELECT conv_id AS id, min(turn) AS created_at, max(turn) AS updated_at, count(*) AS total_messages FROM conversations GROUP BY 1")
def k16(spark, d):
    old = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("timestamp"))
    return stores.migrate(old, old.where("false"))


@query("f23_status", """SELECT CASE WHEN t <> '' AND (regexp_matches(t, '^[^a-zA-Z0-9À-ÿ"'']') OR regexp_matches(t, '(?i)bjbj')) THEN 'error' WHEN t <> '' AND source <> '' AND lang <> '' THEN 'complete' ELSE 'partial' END AS status, count(*) AS n
FROM (SELECT string_split(text, chr(10))[1] AS t, source, lang FROM documents) GROUP BY 1""")
def f23(spark, d):
    t = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, d, "documents").groupBy(stores.document_status(t, F.col("source"), F.col("lang")).alias("status")).agg(F.count("*").alias("n"))


@query("f24_table_search", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'licens') OR contains(lower(source), 'licens')) AND lang = 'en'")
def f24(spark, d):
    return stores.search_table(table(spark, d, "documents"), "Licens", ["text", "source"], "en", "lang").select("doc_id")


@query("h13_intents", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(trim(text)), '^(hi|hello|hey|bonjour|salut|good (morning|evening))\\b') THEN 'greeting' WHEN regexp_matches(lower(trim(text)), '^(thanks|thank you|merci|ok|bye)\\b') THEN 'chitchat' ELSE 'question' END AS intent FROM conversations")
def h13(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", agents.guess_intent(F.col("text")).alias("intent"))
