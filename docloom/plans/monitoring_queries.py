"""Queries of the monitoring operators over events as the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_path
from ..operators import figures
from ..operators import monitoring as m
from .suite import query, table

NOW = "2024-01-31 00:00:00"
_INTENT = {"view": "question", "click": "clarification", "signup": "greeting", "purchase": "chitchat", "error": "out_of_scope"}


def query_log(spark: SparkSession, d: str) -> DataFrame:
    """events as a query log."""
    k = json_path(F.col("props"), "k").cast("int")
    ms = F.floor(F.col("value") * 10).cast("int")
    intent = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in _INTENT.items()])
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        "user_id",
        F.col("props").alias("query"),
        F.col("event_type").alias("answer"),
        intent.alias("intent"),
        (F.col("event_type") == "view").alias("needs_rag"),
        ms.alias("total_latency_ms"),
        F.floor(ms / 10).cast("int").alias("analyzer_latency_ms"),
        F.floor(ms / 8).cast("int").alias("rewriting_latency_ms"),
        F.floor(ms / 4).cast("int").alias("retrieval_latency_ms"),
        F.floor(ms / 5).cast("int").alias("reranking_latency_ms"),
        F.floor(ms / 2).cast("int").alias("generation_latency_ms"),
        (F.col("event_type") != "error").alias("success"),
        F.when(k >= 80, "positive").when(k < 20, "negative").alias("feedback"),
        (F.col("value") / 1e4).alias("cost"),
    )


LOG = """log AS (
 SELECT event_id AS id, ts, user_id, props AS query, event_type AS answer,
  CASE event_type WHEN 'view' THEN 'question' WHEN 'click' THEN 'clarification' WHEN 'signup' THEN 'greeting' WHEN 'purchase' THEN 'chitchat' WHEN 'error' THEN 'out_of_scope' END AS intent,
  event_type = 'view' AS needs_rag, floor(value * 10)::INT AS ms, event_type <> 'error' AS success,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 80 THEN 'positive' WHEN CAST(json_extract_string(props, '$.k') AS INT) < 20 THEN 'negative' END AS feedback,
  value / 1e4 AS cost FROM events)"""
_AT = f"TIMESTAMP '{NOW}'"


def _metrics(hours: int) -> str:
    return f"""SELECT count(*) AS total_queries, coalesce(count(*) FILTER (WHERE success) / nullif(count(*), 0)::DOUBLE, 0) AS success_rate,
 coalesce(round_even(avg(ms) FILTER (WHERE ms > 0), 0), 0)::BIGINT AS avg_latency_ms, coalesce(round_even(quantile_cont(ms, 0.95) FILTER (WHERE ms > 0), 0), 0)::BIGINT AS p95_latency_ms,
 coalesce(round_even(sum(cost), 6), 0) AS total_cost_usd,
 coalesce(count(*) FILTER (WHERE feedback = 'negative') / nullif(count(feedback), 0)::DOUBLE, 0) AS negative_feedback_rate
 FROM log WHERE ts >= {_AT} - INTERVAL {hours} HOUR"""


@query("g01_metrics", f"WITH {LOG} {_metrics(168)}")
def g01(spark, d):
    return m.metrics(query_log(spark, d), NOW, 168)


@query("g01_merged_hours", f"""WITH {LOG}, w AS (SELECT * FROM log WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-24 00:00:00')
SELECT count(*) AS total_queries, coalesce(count(*) FILTER (WHERE success) / nullif(count(*), 0)::DOUBLE, 0) AS success_rate, coalesce(round_even(avg(ms) FILTER (WHERE ms > 0), 0), 0)::BIGINT AS avg_latency_ms,
 coalesce(count(*) FILTER (WHERE feedback = 'negative') / nullif(count(feedback), 0)::DOUBLE, 0) AS negative_feedback_rate, TRUE AS p95_close, TRUE AS users_close FROM w""")
def g01_merged(spark, d):
    """Two weeks from hourly summaries; the sketches' figures are held against the log: the rank of the percentile within 0.02, users within 6 %."""
    log = query_log(spark, d)
    start, end = "2024-01-10", "2024-01-24"
    got = figures.metrics(figures.summaries(log), start, end)
    inside = log.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    lat = F.col("total_latency_ms")
    held = inside.crossJoin(F.broadcast(got)).agg(
        (F.count_if((lat > 0) & (lat <= F.col("p95_latency_ms"))) / F.count_if(lat > 0)).alias("below"), (F.count_if((lat > 0) & (lat < F.col("p95_latency_ms"))) / F.count_if(lat > 0)).alias("under"), F.count_distinct("user_id").alias("distinct")
    )
    close = (F.col("below") > 0.93) & (F.col("under") < 0.97)
    out = got.crossJoin(F.broadcast(held)).withColumn("p95_close", close).withColumn("users_close", F.abs(F.col("users") - F.col("distinct")) <= 0.06 * F.col("distinct") + 1)
    return out.select("total_queries", "success_rate", "avg_latency_ms", "negative_feedback_rate", "p95_close", "users_close")


@query("g02_activity", f"""WITH {LOG}, days AS (SELECT unnest(generate_series(DATE '2024-01-18', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day),
c AS (SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (WHERE intent IN ('question', 'clarification') OR needs_rag) AS rag FROM log WHERE ts >= {_AT} - INTERVAL 14 DAY GROUP BY 1)
SELECT strftime(days.day, '%Y-%m-%d') AS day, coalesce(total, 0) AS total, coalesce(rag, 0) AS rag, coalesce(total, 0) - coalesce(rag, 0) AS non_rag FROM days LEFT JOIN c ON days.day = c.day""")
def g02(spark, d):
    return m.activity(query_log(spark, d), NOW, 14).withColumn("day", F.col("day").cast("string"))


@query("g03_intents", f"""WITH {LOG}, c AS (SELECT intent, count(*) AS count FROM log WHERE ts >= {_AT} - INTERVAL 168 HOUR GROUP BY 1)
SELECT intent, count, round_even(count / (sum(count) OVER ())::DOUBLE, 4) AS percentage FROM c""")
def g03(spark, d):
    return m.intents(query_log(spark, d), NOW, 168)


@query("g04_feedback", f"""WITH {LOG}, c AS (SELECT
 count(*) FILTER (WHERE n AND feedback = 'positive') AS positive, count(*) FILTER (WHERE n AND feedback = 'negative') AS negative, count(*) FILTER (WHERE n AND feedback IS NULL) AS without_feedback,
 count(*) FILTER (WHERE NOT n AND feedback = 'positive') AS p0, count(*) FILTER (WHERE NOT n AND feedback = 'negative') AS n0
 FROM (SELECT *, ts >= {_AT} - INTERVAL 7 DAY AS n FROM log WHERE ts >= {_AT} - INTERVAL 14 DAY)),
r AS (SELECT *, coalesce(positive / nullif(positive + negative, 0)::DOUBLE, 0) AS a, coalesce(p0 / nullif(p0 + n0, 0)::DOUBLE, 0) AS b FROM c)
SELECT positive, negative, without_feedback, round_even(a, 4) AS positive_rate, round_even((a - b) * 100, 2) AS trend FROM r""")
def g04(spark, d):
    return m.feedback_stats(query_log(spark, d), NOW, 7)


@query("g05_latencies", f"""WITH {LOG}, s AS (SELECT floor(ms / 10)::INT AS a, floor(ms / 8)::INT AS w, floor(ms / 4)::INT AS r, floor(ms / 5)::INT AS k, floor(ms / 2)::INT AS g, ms FROM log WHERE ts >= {_AT} - INTERVAL 168 HOUR)
SELECT coalesce(round_even(avg(a) FILTER (WHERE a > 0), 0), 0)::BIGINT AS analyzer_ms, coalesce(round_even(avg(w) FILTER (WHERE w > 0), 0), 0)::BIGINT AS rewriting_ms,
 coalesce(round_even(avg(r) FILTER (WHERE r > 0), 0), 0)::BIGINT AS retrieval_ms, coalesce(round_even(avg(k) FILTER (WHERE k > 0), 0), 0)::BIGINT AS reranking_ms,
 coalesce(round_even(avg(g) FILTER (WHERE g > 0), 0), 0)::BIGINT AS generation_ms, coalesce(round_even(avg(ms) FILTER (WHERE ms > 0), 0), 0)::BIGINT AS total_ms FROM s""")
def g05(spark, d):
    return m.latency_breakdown(query_log(spark, d), NOW, 168)


@query("g06_search_log", f"""WITH {LOG}, f AS (SELECT id, ts FROM log WHERE intent = 'question' AND feedback IS NULL AND ts >= {_AT} - INTERVAL 20 DAY AND (contains(lower(query), '"k"') OR contains(lower(answer), '"k"'))),
r AS (SELECT id, row_number() OVER (ORDER BY ts DESC, id) AS place, count(*) OVER () AS total FROM f)
SELECT id, place::INT AS place, total, 100 < total AS has_more FROM r WHERE place > 50 AND place <= 100""")
def g06(spark, d):
    hits = m.search_log(query_log(spark, d), "question", "none", '"k"', NOW, 20).select("id", "ts")
    return m.page(hits, [F.desc("ts"), F.col("id")], 2, 50).select("id", "place", "total", "has_more")


@query("g07_recent", f"WITH {LOG} SELECT id, intent, ms AS total_latency_ms FROM log ORDER BY ts DESC, id LIMIT 25")
def g07(spark, d):
    return query_log(spark, d).orderBy(F.desc("ts"), "id").limit(25).select("id", "intent", "total_latency_ms")


@query("g08_alerts", f"""WITH {LOG}, f AS ({_metrics(168)})
SELECT 'latency_p95' AS metric, p95_latency_ms::DOUBLE AS current_value, 900::DOUBLE AS threshold, 'warning' AS severity FROM f WHERE p95_latency_ms > 900
UNION ALL SELECT 'success_rate', success_rate, 0.9, CASE WHEN success_rate < 0.7 THEN 'critical' ELSE 'warning' END FROM f WHERE total_queries > 0 AND success_rate < 0.9
UNION ALL SELECT 'daily_cost', total_cost_usd, 1.0, 'warning' FROM f WHERE total_cost_usd > 1
UNION ALL SELECT 'negative_feedback', negative_feedback_rate, 0.4, 'warning' FROM f WHERE negative_feedback_rate > 0.4""")
def g08(spark, d):
    return m.alerts(m.metrics(query_log(spark, d), NOW, 168), p95=900)


@query("g09_ingestion_stats", """
WITH p AS (SELECT source AS doc_id, len(regexp_extract_all(text, '\\S+')) AS t FROM documents)
SELECT count(DISTINCT doc_id) AS total_documents, count(*) AS total_chunks, sum(t)::BIGINT AS total_tokens, round_even(count(DISTINCT doc_id) / 25::DOUBLE * 100, 2) AS coverage_percent, '2024-01-03' AS last_updated FROM p""")
def g09(spark, d):
    from ..functions.text import token_count

    points = table(spark, d, "documents").select(F.col("source").alias("doc_id"), token_count(F.col("text")).alias("chunk_tokens"))
    history = spark.createDataFrame([("v1", "2024-01-01", "completed", "2024-01-02"), ("v2", "2024-01-02", "completed", "2024-01-03"), ("v3", "2024-01-04", "failed", "2024-01-05")], "version string, started_at string, status string, completed_at string")
    return m.ingestion_stats(points, 25, history)


@query("g12_set_feedback", f"""WITH {LOG} SELECT l.id, CASE WHEN l.intent = 'greeting' AND l.feedback IS NULL THEN 'positive' ELSE l.feedback END AS feedback FROM log l""")
def g12(spark, d):
    log = query_log(spark, d)
    votes = log.where("intent = 'greeting' and feedback is null").select("id", F.lit("positive").alias("feedback"))
    return m.set_feedback(log, votes).select("id", "feedback")


@query("k10_redact", f"WITH {LOG} SELECT id, NULL::VARCHAR AS query, answer FROM log")
def k10(spark, d):
    return m.redact(query_log(spark, d), keep_query=False).select("id", "query", "answer")


@query("k11_rotate", f"""WITH {LOG}, n AS (SELECT count(*) AS n FROM log), l AS (SELECT n - n // 3 AS a FROM n), r AS (SELECT id, row_number() OVER (ORDER BY ts DESC, id DESC) AS place FROM log)
SELECT id FROM r, l WHERE place <= a""")
def k11(spark, d):
    log = query_log(spark, d)
    n = log.count()
    return m.rotate(log, n - 1).select("id")


@query("k12_purge", f"WITH {LOG} SELECT id FROM log WHERE ts >= {_AT} - INTERVAL 10 DAY")
def k12(spark, d):
    return m.purge(query_log(spark, d), NOW, 10).select("id")


@query("g_rollup", f"WITH {LOG} SELECT intent, feedback, count(*) AS n FROM log GROUP BY ROLLUP (intent, feedback)")
def g_rollup(spark, d):
    return query_log(spark, d).rollup("intent", "feedback").agg(F.count("*").alias("n"))
