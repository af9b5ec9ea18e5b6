"""Routing of questions: answers of an analyser, messages for a model, defaults that need no model."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTENTS = ("question", "clarification", "greeting", "chitchat", "out_of_scope")
NEEDS_RAG = ("question", "clarification")


def parse_analysis(answer: Column) -> Column:
    """struct<intent, confidence, needs_rag> from an analyser's text, fenced or not; a question at 0.5 where it says nothing usable."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    data = F.from_json(body, "intent string, confidence double, needs_rag boolean")
    intent = F.lower(F.trim(data["intent"]))
    ok = F.coalesce(intent.isin(*INTENTS), F.lit(False))
    return F.struct(
        F.when(ok, intent).otherwise("question").alias("intent"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(data["confidence"], F.lit(0.5))))).otherwise(0.5).alias("confidence"),
        F.when(ok, F.coalesce(data["needs_rag"], intent.isin(*NEEDS_RAG))).otherwise(True).alias("needs_rag"),
    )


def guess_intent(question: Column) -> Column:
    """The intent of a question by its words: the analyser that needs no model."""
    q = F.lower(F.trim(question))
    return F.when(q.rlike(r"^(hi|hello|hey|bonjour|salut|good (morning|evening))\b"), "greeting").when(q.rlike(r"^(thanks|thank you|merci|ok|bye)\b"), "chitchat").otherwise("question")


def messages(system: Column, history: Column, context: Column, question: Column, language: str | None = None) -> Column:
    """array<struct<role, content>> for a model: system, the history's filled turns of known roles, context and question."""
    line = {"fr": "\nReponds en francais.", "en": "\nAnswer in English."}.get(language or "", "")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    kept = F.filter(history, lambda m: F.lower(m["role"]).isin("user", "assistant", "system") & (F.coalesce(m["content"], F.lit("")) != ""))
    kept = F.transform(kept, lambda m: turn(F.lower(m["role"]), m["content"]))
    asked = F.concat(context, F.lit("\n\nQuestion : "), question, F.lit(line))
    return F.concat(F.array(turn(F.lit("system"), system)), kept, F.array(turn(F.lit("user"), asked)))


#: What a model is told where a question asks nothing of the documents; {response_language} is put in.
PROMPTS = {
    "greeting": "You greet the user shortly and offer to answer questions about the documents. Answer in {response_language}.",
    "out_of_scope": "You say politely that you answer questions about the documents only. Answer in {response_language}.",
}


def plain_messages(question: Column, history: Column, intent: Column, language: str = "francais", prompts: dict[str, str] | None = None) -> Column:
    """array<struct<role, content>> for a question that needs no documents: the prompt of its intent, the last four turns, the question.

    Chitchat, and an intent without a prompt, has that of greetings.
    """
    told = {k: v.replace("{response_language}", language) for k, v in (prompts or PROMPTS).items()}
    system = F.when(intent == "out_of_scope", told["out_of_scope"]).otherwise(told["greeting"])
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    last = F.slice(history, F.greatest(F.size(history) - 3, F.lit(1)), F.lit(4))
    last = F.transform(last, lambda m: turn(F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("user")), F.coalesce(m["content"], F.lit(""))))
    return F.concat(F.array(turn(F.lit("system"), system)), last, F.array(turn(F.lit("user"), question)))


def retrying(call: Callable[[list[str]], list], tries: int = 4, first: float = 0.25, most: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list]:
    """A model, embedder or scorer that is asked again after min(first * 2 ** n, most) seconds where it fails."""

    def run(batch: list[str]) -> list:
        for n in range(tries - 1):
            try:
                return call(batch)
            except Exception:  # whatever a service does
                sleep(min(first * 2**n, most))
        return call(batch)

    return run


def rewrites(questions: DataFrame, model: Callable[[list[str]], list[str]] | None, n: int = 1, template: str = "{conversation_history}\n{user_query}", id_col: str = "query_id") -> DataFrame:
    """(id_col, place, text): up to ``n`` rewrites of each question (id_col, text, history) by ``model``, without quotes around them.

    Blank answers and those that differ only in letter case from an earlier one go; without a model, or where nothing is left,
    the question stands for itself.
    """
    from .fusion import distinct_queries

    asked = questions.select(id_col, "text")
    if model is None or n <= 0:
        return asked.select(id_col, F.lit(0).alias("place"), "text")
    filled = F.replace(F.replace(F.lit(template), F.lit("{conversation_history}"), F.coalesce("history", F.lit("(no history)"))), F.lit("{user_query}"), F.col("text"))
    each = questions.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"), filled.alias("prompt"))
    each = each.withColumn("__key", F.struct(id_col, "place"))
    got = generate(each.select(F.to_json("__key").alias("k"), "prompt"), model, "k").select("k", F.regexp_replace(F.trim("answer"), "^[\"']+|[\"']+$", "").alias("text"))
    kind = questions.schema[id_col].dataType.simpleString()
    got = got.where("text is not null and text <> ''").select(F.from_json("k", f"`{id_col}` {kind}, place int").alias("x"), "text").select(f"x.{id_col}", "x.place", "text")
    got = distinct_queries(got.withColumnRenamed(id_col, "query_id")).withColumnRenamed("query_id", id_col)
    alone = asked.join(got.select(id_col).distinct(), id_col, "left_anti").select(id_col, F.lit(0).alias("place"), "text")
    return got.select(id_col, "place", "text").unionByName(alone)


def answer(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    model: Callable[[list[str]], list[str]] | None = None,
    rewriter: Callable[[list[str]], list[str]] | None = None,
    n_rewrites: int = 1,
    max_chunks: int = 5,
    max_tokens: int = 2000,
    system: str = "Answer from the sources only.",
    language: str | None = None,
) -> DataFrame:
    """(query_id, intent, needs_rag, context, sources, answer, error): a set of questions (query_id, text, history array<struct<role, content>>) answered.

    Each question is routed by its intent. Those that need documents are rewritten, their rewrites searched by ``retrieve`` (query_id,
    text to query_id, id, score, text, title), the results merged and put together within a budget; the others get the
    prompt of their intent. All goes to ``model`` (the first source by default) in one pass. What fails has its error in its own row,
    which is the entry of the query log.
    """
    from . import context, fusion

    kind = "array<struct<role:string,content:string>>"
    history = F.col("history") if "history" in questions.columns else F.array().cast(kind)
    rows = questions.select("query_id", "text", F.coalesce(history, F.array().cast(kind)).alias("history")).withColumn("intent", guess_intent(F.col("text"))).withColumn("needs_rag", F.col("intent").isin(*NEEDS_RAG))
    lines = F.array_join(F.transform("history", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    asked = rewrites(rows.where("needs_rag").select("query_id", "text", lines.alias("history")), rewriter, n_rewrites)
    asked = asked.select(F.to_json(F.struct("query_id", "place")).alias("query_id"), "text")
    id_kind = questions.schema["query_id"].dataType.simpleString()
    hits = retrieve(asked).withColumn("query_id", F.from_json("query_id", f"query_id {id_kind}")["query_id"])
    merged = fusion.merge_queries(hits.select("query_id", "id", "score", "text", "title"))
    chosen = context.assemble(merged, max_chunks, max_tokens)
    told = context.format_context(chosen)
    listed = chosen.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("source_id", "id"))), lambda s: s["id"]).alias("sources"))
    rows = rows.join(told, "query_id", "left").join(listed, "query_id", "left")
    rag = messages(F.lit(system), F.col("history"), F.coalesce("context", F.lit("<context>\n</context>")), F.col("text"), language)
    prompt = F.to_json(F.when(F.col("needs_rag"), rag).otherwise(plain_messages(F.col("text"), F.col("history"), F.col("intent"))))
    got = generate(rows.select("query_id", prompt.alias("prompt")), model or first_source)
    return rows.join(got, "query_id").select("query_id", "intent", "needs_rag", "context", "sources", "answer", "error")


def first_source(prompts: list[str]) -> list[str]:
    """extractive for prompts that are messages in JSON: the first source of the last message's context, or "" without one."""
    return extractive([json.loads(p)[-1]["content"] for p in prompts])


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]], id_col: str = "query_id", text_col: str = "prompt") -> DataFrame:
    """(id_col, answer, error) by any model of a list of prompts; a failing batch has errors and fails nothing else."""
    kind = prompts.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[[id_col]].copy()
            try:
                out["answer"], out["error"] = model(frame[text_col].fillna("").tolist()), None
            except Exception as e:  # whatever a service does
                out["answer"], out["error"] = None, f"{type(e).__name__}: {e}"
            yield out

    return prompts.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, answer string, error string")


def extractive(prompts: list[str]) -> list[str]:
    """The model that needs no network: the first source of the context."""
    return [p.partition('">\n')[2].partition("\n</source>")[0][:500] for p in prompts]
