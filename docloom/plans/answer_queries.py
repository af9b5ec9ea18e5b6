"""Queries of rewrites, routing, answers, schedules and rebuilt indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agents, lexical, stores
from ..operators.cut import cut
from ..streaming import streams
from . import search
from .search_queries import W, bm25_sql
from .suite import query, table


def _history(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ts"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))
    return stores.history_rows(rows)


@query("m10_history_rows", "SELECT conv_id AS conversation_id, count(*) AS n, sha256(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def m10(spark, d):
    lines = F.array_join(F.transform("history", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")
    return _history(spark, d).select("conversation_id", F.size("history").cast("long").alias("n"), F.sha2(lines, 256).alias("digest"))


@query("m09_plain_messages", """WITH l AS (SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id AS conversation_id, count(*) + 2 AS n, sha256(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || 'user:hello') AS digest FROM l WHERE n <= 4 GROUP BY 1""")
def m09(spark, d):
    told = agents.plain_messages(F.lit("hello"), F.col("history"), F.lit("greeting"))
    rows = _history(spark, d).select("conversation_id", told.alias("m"))
    lines = F.array_join(F.transform(F.slice("m", F.lit(2), F.size("m")), lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")
    return rows.select("conversation_id", F.size("m").cast("long").alias("n"), F.sha2(lines, 256).alias("digest"))


def _twice(prompts: list[str]) -> list[str]:
    """A stand-in for a rewriting model: the question in capitals, between quotes."""
    return [f'"{p.rpartition(chr(10))[2].upper()}"' for p in prompts]


@query("h14_rewrites", "SELECT part.p_partkey AS query_id, 0 AS place, upper(p_name) AS text FROM part")
def h14(spark, d):
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"), F.lit("before").alias("history"))
    return agents.rewrites(asked, _twice, 3)


@query("m13_answers", f"""WITH {bm25_sql(0)}, x AS (SELECT l.query_id, l.id, l.rank, regexp_extract_all(text, '\\S+') AS ts, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM lex l JOIN documents d ON d.doc_id = l.id WHERE rank <= 5),
s AS (SELECT *, len(ts) AS n, coalesce(sum(len(ts)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WHERE text <> ''),
c AS (SELECT *, CASE WHEN before + n > 800 THEN array_to_string(ts[1 : 800 - before::INT], ' ') ELSE text END AS shown FROM s WHERE before + n <= 800 OR 800 - before >= 50)
SELECT query_id, 'question' AS intent, string_agg(id, ',' ORDER BY rank) AS sources, sha256(arg_min(shown, rank)[1:500]) AS answer FROM c GROUP BY 1""")
def m13(spark, d):
    docs = table(spark, d, "documents")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")

    def retrieve(queries):
        hits = cut(search.lexical_search(docs, queries, search.SearchConfig(top_k=5)))
        if hits.count() <= search.MOST_TERMS:  # sent to the texts, which then stay where they are
            hits = F.broadcast(hits)
        return hits.join(docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title")), "id")

    out = agents.answer(asked, retrieve, max_tokens=800)
    return out.select("query_id", "intent", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), F.sha2("answer", 256).alias("answer"))


@query("k06_rebuilt_index", f"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS ts FROM documents WHERE trim(text) <> '' AND source <> 'src1')
SELECT count(*) AS postings, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS tokens FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL)""")
def k06(spark, d):
    points = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("source") != "src1", F.col("text")).alias("text"))
    return lexical.rebuilt(points)[0].agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("tokens"))


@query("w02_due", """SELECT user_id AS source FROM (SELECT user_id, max(ts) AS ts, CASE user_id % 3 WHEN 0 THEN INTERVAL 15 MINUTE WHEN 1 THEN INTERVAL 6 HOUR ELSE INTERVAL 7 DAY END AS i FROM events GROUP BY user_id) WHERE ts + i <= TIMESTAMP '2024-01-31 00:00:00'""")
def w02(spark, d):
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("last_run"))
    interval = F.when(F.col("source") % 3 == 0, "15m").when(F.col("source") % 3 == 1, "6h").otherwise("7d")
    return streams.due(last.withColumn("interval", interval), "2024-01-31 00:00:00").select("source")
