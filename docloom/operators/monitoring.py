"""Figures about a query log.

A log has id, ts, intent, needs_rag, total_latency_ms, success, feedback, cost and further latencies. ``now`` is
always given, never the clock, so that runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAG_INTENTS = ("question", "clarification")
STAGES = ("analyzer", "rewriting", "retrieval", "reranking", "generation", "total")


def _now(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def since(log: DataFrame, now: str, hours: float, until_hours: float = 0) -> DataFrame:
    """The log from ``hours`` before ``now``; before ``until_hours`` before it, if given."""
    out = log.where(F.col("ts") >= _now(now) - F.make_dt_interval(hours=F.lit(int(hours))))
    if until_hours:
        out = out.where(F.col("ts") < _now(now) - F.make_dt_interval(hours=F.lit(int(until_hours))))
    return out


def _rounded(x: Column) -> Column:
    """Half to even, as a whole number; 0 without values."""
    return F.coalesce(F.bround(x, 0), F.lit(0.0)).cast("long")


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def metrics(log: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """One row: queries, success rate, mean and 95th percentile of latencies above 0, cost, rate of negative feedback."""
    lat = F.when(F.col("total_latency_ms") > 0, F.col("total_latency_ms"))
    pos, neg = F.count_if(F.col("feedback") == "positive"), F.count_if(F.col("feedback") == "negative")
    return since(log, now, max(1, hours)).agg(
        F.count("*").alias("total_queries"),
        _rate(F.count_if("success"), F.count("*")).alias("success_rate"),
        _rounded(F.avg(lat)).alias("avg_latency_ms"),
        _rounded(F.percentile(lat, 0.95)).alias("p95_latency_ms"),
        F.coalesce(F.bround(F.sum("cost"), 6), F.lit(0.0)).alias("total_cost_usd"),
        _rate(neg, pos + neg).alias("negative_feedback_rate"),
    )


def activity(log: DataFrame, now: str, days: int = 7) -> DataFrame:
    """(day, total, rag, non_rag) of each of the last ``days`` days, with zeros."""
    days = max(1, days)
    last = F.to_date(_now(now))
    spine = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    rag = F.coalesce(F.col("intent").isin(*RAG_INTENTS), F.lit(False)) | F.coalesce("needs_rag", F.lit(False))
    counts = since(log, now, 24 * days).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if(rag).alias("rag"))
    zero = F.lit(0).cast("long")
    out = spine.join(counts, "day", "left").select("day", F.coalesce("total", zero).alias("total"), F.coalesce("rag", zero).alias("rag"))
    return out.withColumn("non_rag", F.col("total") - F.col("rag"))


def intents(log: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """(intent, count, percentage) by count, then name; null and empty are unknown."""
    counts = since(log, now, max(1, hours)).groupBy(F.coalesce(F.nullif("intent", F.lit("")), F.lit("unknown")).alias("intent")).agg(F.count("*").alias("count"))
    share = F.bround(F.col("count") / F.sum("count").over(Window.partitionBy()), 4)
    return counts.withColumn("percentage", share).orderBy(F.desc("count"), "intent")


def feedback_stats(log: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Feedback of the last ``days`` days and how the positive rate moved since the ``days`` before, in points."""
    days = max(1, days)
    new = F.col("ts") >= _now(now) - F.make_dt_interval(days=F.lit(days))
    n = lambda cond: F.count_if(cond)
    pos, neg = F.col("feedback") == "positive", F.col("feedback") == "negative"
    out = since(log, now, 48 * days).agg(
        n(new & pos).alias("positive"), n(new & neg).alias("negative"), n(new & F.col("feedback").isNull()).alias("without_feedback"), n(~new & pos).alias("p0"), n(~new & neg).alias("n0")
    )
    rate, old = _rate(F.col("positive"), F.col("positive") + F.col("negative")), _rate(F.col("p0"), F.col("p0") + F.col("n0"))
    return out.select("positive", "negative", "without_feedback", F.bround(rate, 4).alias("positive_rate"), F.bround((rate - old) * 100, 2).alias("trend"))


def latency_breakdown(log: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Mean of the latencies above 0 of each stage."""
    return since(log, now, max(1, hours)).agg(*[_rounded(F.avg(F.when(F.col(f"{s}_latency_ms") > 0, F.col(f"{s}_latency_ms")))).alias(f"{s}_ms") for s in STAGES])


def search_log(log: DataFrame, intent: str | None = None, feedback: str | None = None, contains: str | None = None, now: str | None = None, since_days: int | None = None) -> DataFrame:
    """The entries that fit; feedback "none" means none was given. Text is looked for in query and answer."""
    out = log
    if intent:
        out = out.where(F.col("intent") == intent)
    if feedback:
        out = out.where(F.col("feedback").isNull() if feedback == "none" else F.col("feedback") == feedback)
    if contains:
        seen = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(contains.lower()) for c in ("query", "answer") if c in log.columns]
        out = out.where(seen[0] | seen[-1])
    if now and since_days:
        out = out.where(F.col("ts") >= _now(now) - F.make_dt_interval(days=F.lit(since_days)))
    return out


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows ``(number - 1) * size`` on, with their place, how many there are and whether more follow.

    Only the rows up to the page's end are ordered, by a top-k; the count is a sum beside it.
    """
    end = number * size
    top = rows.orderBy(*order).limit(end)
    total = rows.agg(F.count("*").alias("total"))
    ranked = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > end - size)
    return ranked.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(end) < F.col("total"))


def alerts(figures: DataFrame, p95: float = 5000, success: float = 0.9, daily_cost: float = 1.0, negative: float = 0.4) -> DataFrame:
    """(metric, current_value, threshold, severity) of what is beyond its limit in one row of figures."""

    def one(metric, value, limit, bad, severity):
        return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("current_value"), F.lit(float(limit)).alias("threshold"), severity.alias("severity"), bad.alias("bad"))

    warn, ok = F.lit("warning"), F.col("success_rate")
    checks = F.array(
        one("latency_p95", F.col("p95_latency_ms"), p95, F.col("p95_latency_ms") > p95, warn),
        one("success_rate", ok, success, (F.col("total_queries") > 0) & (ok < success), F.when(ok < 0.7, "critical").otherwise("warning")),
        one("daily_cost", F.col("total_cost_usd"), daily_cost, F.col("total_cost_usd") > daily_cost, warn),
        one("negative_feedback", F.col("negative_feedback_rate"), negative, F.col("negative_feedback_rate") > negative, warn),
    )
    return figures.select(F.inline(checks)).where("bad").drop("bad")


def redact(log: DataFrame, keep_query: bool = True, keep_answer: bool = True, keep_sources: bool = True) -> DataFrame:
    """The log without what its settings say not to keep."""
    for column, keep in (("query", keep_query), ("answer", keep_answer), ("sources", keep_sources)):
        if column in log.columns and not keep:
            log = log.withColumn(column, F.lit(None).cast(log.schema[column].dataType))
    return log


def purge(log: DataFrame, now: str, days: int) -> DataFrame:
    return log.where(F.col("ts") >= _now(now) - F.make_dt_interval(days=F.lit(max(1, days))))


def rotate(log: DataFrame, most_rows: int, rounds: int = 5) -> DataFrame:
    """Drops the oldest third, one row at least, while the log has more rows than ``most_rows``, ``rounds`` times at most.

    The rows that stay are those after a minute found by counts a minute, and in that minute the latest: only it is put in order.
    """
    n = left = log.count()
    for _ in range(rounds):
        if left <= most_rows:
            break
        left -= max(1, left // 3)
    if left == n:
        return log
    minute = F.date_trunc("minute", F.col("ts"))
    counts = log.groupBy(minute.alias("minute")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, 0))
    edge = counts.withColumn("upto", upto).where(F.col("upto") >= left).orderBy("upto").first()
    later = log.where(minute > F.lit(edge["minute"])) if edge["minute"] is not None else log.where("ts is not null")
    same = log.where(minute.eqNullSafe(F.lit(edge["minute"]))).orderBy(F.desc("ts"), F.desc("id")).limit(left - (edge["upto"] - edge["n"]))
    return later.unionByName(same)


def set_feedback(log: DataFrame, votes: DataFrame) -> DataFrame:
    """The log with the feedback of ``votes`` (id, feedback) where that is positive or negative."""
    new = votes.where(F.col("feedback").isin("positive", "negative")).groupBy("id").agg(F.max("feedback").alias("__new"))
    return log.join(new, "id", "left").withColumn("feedback", F.coalesce("__new", "feedback")).drop("__new").select(log.columns)


def ingestion_stats(points: DataFrame, source_documents: int, history: DataFrame) -> DataFrame:
    """Documents, chunks and tokens in the index, part of the sources' documents in it, end of the last complete run."""
    filled = F.nullif(F.trim(F.col("doc_id").cast("string")), F.lit(""))
    tokens = F.sum(F.when(F.col("chunk_tokens") > 0, F.col("chunk_tokens")))
    out = points.agg(F.count_distinct(filled).alias("total_documents"), F.count("*").alias("total_chunks"), F.coalesce(tokens, F.lit(0)).cast("long").alias("total_tokens"))
    cover = F.bround(F.col("total_documents") / source_documents * 100, 2) if source_documents else F.lit(0.0)
    last = history.where(F.col("status") == "completed").agg(F.max_by("completed_at", "started_at").alias("last_updated"))
    return out.withColumn("coverage_percent", cover).crossJoin(F.broadcast(last))
