"""Chat formatting: every assistant turn becomes a training example of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: The template. A rendered turn is OPEN, role, BODY, text, CLOSE; texts and roles hold no "<" once escaped.
OPEN, BODY, CLOSE = "<turn>", "<body>", "</turn>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def expand_targets(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One example for every assistant turn: all turns before it as context, only its text trainable.

    Returns conv_id, example (long, from 0), formatted (string), loss_start and loss_end (int, code points:
    the trainable span of ``formatted``, which is the escaped text of the last turn). Turns behind
    the last reply, or of a conversation without one, come in a closing example whose span is empty.

    Turns go by turn number, null first, and ties by role and text, so repeated rows stay and reruns
    agree; null roles and texts are empty; rows with a null conversation are one conversation.
    The examples of a conversation hold the square of its length, as the method has it; a conversation
    is one row while it is built, so that it must fit a task. Other columns are dropped.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    head = lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(BODY))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), F.char_length(escape(x["text"])).alias("chars"), F.concat(head(x), escape(x["text"]), F.lit(CLOSE)).alias("whole"))).alias("turns"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == target_role) | (i == F.size("turns")))
    shown = convs.select("conv_id", "turns", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("turns", F.col("end"))
    shown = shown.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("end")), lambda x: x["whole"]), "").alias("formatted"),
        F.when(last["role"] == target_role, last["chars"]).otherwise(0).alias("chars"),
    )
    stop = F.char_length("formatted") - len(CLOSE)
    return shown.select("conv_id", "example", "formatted", (stop - F.col("chars")).alias("loss_start"), stop.alias("loss_end"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example as array<struct<role, text>>."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    cut = lambda x: F.split(F.substr(x, F.lit(len(OPEN) + 1)), BODY)
    return F.transform(parts, lambda x: F.struct(unescape(F.element_at(cut(x), 1)).alias("role"), unescape(F.element_at(cut(x), 2)).alias("text")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    examples = expand_targets(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    trained = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", unescape(trained).alias("text")))).alias("losses"),
    )
    whole = whole.select("conv_id", read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"), "formatted_chars")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), sized AS (
  SELECT *, {len(OPEN + BODY + CLOSE)} + length(replace(replace(role, '&', '&amp;'), '<', '&lt;'))
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
