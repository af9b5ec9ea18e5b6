"""Contexts, histories and exports of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shorten, token_count, truncate_tokens

LABELS = {"user": "Utilisateur", "assistant": "Assistant"}
LEAST_CUT = 50


def assemble(results: DataFrame, max_chunks: int, max_tokens: int, partition: str = "query_id") -> DataFrame:
    """The chunks of each query (rank, id, text, score) that fit ``max_tokens``, with source_id (their rank) and tokens.

    Blank texts are passed over. The first chunk beyond the budget is cut to what is left of it if that is
    LEAST_CUT tokens or more; then nothing follows. All by a running sum, without a loop.
    """
    w = Window.partitionBy(partition).orderBy("rank")
    rows = results.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''").withColumn("tokens", token_count(F.col("text")))
    rows = rows.withColumn("__n", F.row_number().over(w)).withColumn("__before", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    over, left = F.col("__before") + F.col("tokens") > max_tokens, max_tokens - F.col("__before")
    rows = rows.where((F.col("__n") <= max_chunks) & (~over | (left >= LEAST_CUT)))
    rows = rows.withColumn("truncated", over).withColumn("text", F.when(over, truncate_tokens(F.col("text"), left)).otherwise(F.col("text"))).withColumn("tokens", F.when(over, left).otherwise(F.col("tokens")))
    return rows.withColumn("source_id", F.col("rank")).drop("__n", "__before")


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def format_context(chunks: DataFrame, title: str = "title", page: str | None = None, partition: str = "query_id") -> DataFrame:
    """(query_id, context): the chunks as source elements, in order."""
    number = F.concat(F.lit(' page="'), F.col(page).cast("string"), F.lit('"')) if page else F.lit("")
    head = F.concat(F.lit('<source id="'), F.col("source_id").cast("string"), F.lit('" title="'), _escaped(F.coalesce(F.col(title), F.lit("Document"))), F.lit('"'), F.coalesce(number, F.lit("")), F.lit(' score="'), F.format_string("%.4f", F.col("score")), F.lit('">'))
    one = F.concat_ws("\n", head, F.col("text"), F.lit("</source>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_id", one.alias("x")))), lambda s: s["x"]), "\n")
    return chunks.groupBy(partition).agg(F.concat_ws("\n", F.lit("<context>"), body, F.lit("</context>")).alias("context"))


def sources(chunks: DataFrame) -> DataFrame:
    """The chunks as a list of sources with the start of their texts."""
    return chunks.withColumn("text_preview", shorten(F.col("text"), 200)).drop("text")


def last_messages(messages: DataFrame, n: int, partition: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation."""
    w = Window.partitionBy(partition).orderBy(F.desc(order))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def format_history(messages: DataFrame, n: int = 5, chars: int = 200, partition: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv_id, history): the last ``n`` messages as labelled lines of ``chars`` characters at most."""
    label = F.when(F.col("role") == "user", LABELS["user"]).otherwise(LABELS["assistant"])
    line = F.concat(label, F.lit(": "), F.left(F.trim(F.coalesce("text", F.lit(""))), F.lit(chars)))
    rows = last_messages(messages, n, partition, order)
    return rows.groupBy(partition).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda s: s["line"]), "\n").alias("history"))


def history_tokens(messages: DataFrame, partition: str = "conv_id") -> DataFrame:
    return messages.groupBy(partition).agg(F.sum(F.greatest(F.lit(1).cast("long"), token_count(F.coalesce("text", F.lit(""))))).alias("tokens"))


def overflow_prompt(messages: DataFrame, n: int, partition: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv_id, prompt): what a summariser gets of the messages before the last ``n``, 300 characters each."""
    w = Window.partitionBy(partition).orderBy(F.desc(order))
    old = messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > n)
    label = F.when(F.col("role") == "user", LABELS["user"]).otherwise(LABELS["assistant"])
    line = F.concat(label, F.lit(": "), F.left("text", F.lit(300)))
    return old.groupBy(partition).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda s: s["line"]), "\n").alias("prompt"))


def with_summary(messages: DataFrame, summaries: DataFrame, n: int, partition: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages behind a system message with the summary (conv_id, summary), where there is one."""
    recent = last_messages(messages, n, partition, order).select(partition, order, "role", "text")
    head = summaries.where("summary is not null and summary <> ''").select(partition, F.lit(-1).cast(messages.schema[order].dataType).alias(order), F.lit("system").alias("role"), F.col("summary").alias("text"))
    return head.unionByName(recent)


def title_fallback(messages: DataFrame, partition: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv_id, title): the first message's first 40 characters."""
    return messages.groupBy(partition).agg(F.trim(F.left(F.min_by("text", order), F.lit(40))).alias("title"))


def to_markdown(messages: DataFrame, partition: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conv_id, body): user turns as numbered questions, others as answers with a rule behind."""
    number = F.count_if(F.col("role") == "user").over(Window.partitionBy(partition).orderBy(order))
    user = F.concat(F.lit("## Question "), number.cast("string"), F.lit("\n**Utilisateur** : "), F.col("text"), F.lit("\n"))
    other = F.concat(F.lit("**Assistant** : "), F.col("text"), F.lit("\n\n---\n"))
    rows = messages.withColumn("part", F.when(F.col("role") == "user", user).otherwise(other))
    return rows.groupBy(partition).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "part"))), lambda s: s["part"]), "\n").alias("body"))


def temporal_group(at: Column, now: str) -> Column:
    """today, yesterday, last7days, last30days or older, by whole days before ``now``."""
    day = F.to_date(F.lit(now).cast("timestamp_ntz"))
    ago = lambda n: F.to_date(at) >= F.date_sub(day, n)
    return F.when(ago(0), "today").when(ago(1), "yesterday").when(ago(7), "last7days").when(ago(30), "last30days").otherwise("older")


def latency_estimate(local: Column, top_k: Column, prefetch: Column, max_tokens: Column, context_tokens: Column, context_chunks: Column, rerank: Column, candidates: Column, rewrites: Column, analyze: Column) -> Column:
    """struct<min, max> seconds that an answer is expected to take."""
    rounded = lambda x, n=0: F.floor(x * 10**n + 0.5) / 10**n
    low, high = F.when(local, 5.0).otherwise(0.5), F.when(local, 15.0).otherwise(2.0)
    base = F.when(local, 1.0).otherwise(0.5) * (1 + top_k * prefetch / 100)
    grow = max_tokens / 500 * (1 + context_tokens / F.when(local, 8000).otherwise(16000)) * (1 + context_chunks / 20)
    calls = F.when(analyze, 1 + F.greatest(rewrites, F.lit(1))).otherwise(0)
    least = calls * low + rounded(base, 1) + F.when(rerank, 0.1).otherwise(0.0) + rounded(low * grow, 1)
    most = calls * high + rounded(base * 3, 1) + F.when(rerank, F.least(F.lit(2.0), 0.1 + candidates * 0.03)).otherwise(0.0) + rounded(high * grow, 1)
    return F.struct(rounded(least).cast("long").alias("min"), rounded(most).cast("long").alias("max"))
