"""Rewrites, routing and answers of question sets, schedules, progress, conversation rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions.chunking import ChunkConfig
from docloom.operators import agents, dedup, lexical, stores, vector
from docloom.plans.search import SearchConfig, lexical_search
from docloom.sources.records import rest_pages
from docloom.streaming import streams

HISTORY = "query_id long, text string, history array<struct<role:string,content:string>>"


def test_rewrites_are_cleaned_and_fall_back(spark):
    rows = spark.createDataFrame([(1, "a?", "h"), (2, "b?", None)], "query_id long, text string, history string")

    def model(prompts):
        return ['"One"' if p.endswith("a?") else "  " for p in prompts]

    got = {(r.query_id, r.text) for r in agents.rewrites(rows, model, 3).collect()}
    assert got == {(1, "One"), (2, "b?")}
    assert {(r.query_id, r.text) for r in agents.rewrites(rows, None).collect()} == {(1, "a?"), (2, "b?")}


def test_a_model_is_asked_again():
    calls = []

    def model(batch):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return batch

    waits = []
    assert agents.retrying(model, sleep=waits.append)(["x"]) == ["x"] and waits == [0.25, 0.5]
    with pytest.raises(OSError):
        agents.retrying(lambda b: (_ for _ in ()).throw(OSError("down")), tries=2, sleep=waits.append)(["x"])


def test_answers_of_a_question_set(spark):
    docs = spark.createDataFrame([(1, "the rain in the town"), (2, "sun over the river")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "where is the rain", [("user", "x")]), (11, "hello", None), (12, "nothing matches zzz", [])], HISTORY)

    def retrieve(queries):
        hits = lexical_search(docs, queries, SearchConfig(top_k=3))
        return hits.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").withColumn("title", F.lit("t")).select("query_id", "id", "score", "text", "title")

    seen = []

    def check(prompts):
        for p in prompts:
            m = json.loads(p)
            assert m[0]["role"] == "system" and m[-1]["role"] == "user"
        return agents.first_source(prompts)

    got = {r.query_id: r for r in agents.answer(asked, retrieve, check).collect()}
    assert got[10].answer == "the rain in the town" and got[10].sources == [1, 2][: len(got[10].sources)] and got[10].needs_rag
    assert got[11].intent == "greeting" and got[11].context is None and got[11].answer == "" and not got[11].needs_rag
    assert got[12].context is None and got[12].error is None and not seen
    broken = agents.answer(asked, retrieve, lambda p: 1 / 0).collect()
    assert all(r.answer is None and "ZeroDivisionError" in r.error for r in broken)


def test_plain_messages_keep_the_last_four_turns(spark):
    turns = [("user" if i % 2 else None, str(i)) for i in range(6)]
    rows = spark.createDataFrame([(1, "thanks", turns), (2, "hi", [])], HISTORY)
    got = {r.query_id: r.m for r in rows.select("query_id", agents.plain_messages(F.col("text"), F.col("history"), F.lit("out_of_scope")).alias("m")).collect()}
    assert [m.content for m in got[1]][1:] == ["2", "3", "4", "5", "thanks"] and got[1][1].role == "user" and "francais" in got[1][0].content and len(got[2]) == 2


def test_due_sources(spark):
    rows = spark.createDataFrame([("a", "15m", "2024-01-01 10:00:00"), ("b", "1h", "2024-01-01 10:00:00"), ("c", "7d", None), ("d", "never", None)], "source string, interval string, last_run string").withColumn("last_run", F.col("last_run").cast("timestamp_ntz"))
    assert {r.source for r in streams.due(rows, "2024-01-01 10:20:00").collect()} == {"a", "c"}


def test_progress_is_published(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    events = []
    listener = streams.Progress(lambda e, d: events.append((e, d)), total=10)
    spark.streams.addListener(listener)
    try:
        q = streams.scheduled(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "15m", lambda df, n: df.count(), str(tmp_path / "check"))
        for _ in range(300):
            if any(d.get("done") for _, d in events):
                break
            time.sleep(0.1)
        q.stop()
    finally:
        spark.streams.removeListener(listener)
    assert events[0][0] == "started" and any(e == "progress" and d["done"] == 5 and d["coverage_percent"] == 50.0 and d["eta_seconds"] >= 0 for e, d in events)


def test_conversation_rows(spark):
    m = spark.createDataFrame([("c", 2, 1, "user", "b"), ("c", 1, 2, "user", "a"), ("c", 1, 1, "system", None), ("d", 1, 1, "user", "x")], "conversation_id string, ts long, id long, role string, content string")
    assert [(r.ts, r.id) for r in stores.conversation_messages(m, "c").collect()] == [(1, 1), (1, 2), (2, 1)]
    assert {r.conversation_id: [(h.role, h.content) for h in r.history] for r in stores.history_rows(m).collect()}["c"] == [("system", ""), ("user", "a"), ("user", "b")]


def test_nearest_passes_over_broken_vectors(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.5, None]), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [1.0, 2.0, 3.0]), (6, [0.0, 2.0])], "query_id long, vector array<double>")
    got = sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in vector.knn(points, asked, 2).collect())
    assert got == [(6, 1, 0.0, 2), (6, 5, 1.0, 1), (7, 1, 1.0, 1), (7, 5, 0.0, 2)]
    assert vector.knn(points, asked.where("query_id = 8"), 2).count() == 0


def test_the_last_of_repeated_rows_wins(spark):
    points = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "vec_id long, label string, at int")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "p", 1), (3, "q", 1)], "vec_id long, label string, at int")
    got = {r.vec_id: r.label for r in vector.upsert(points, new, order="at").collect()}
    assert got[1] == "y" and got[2] == "b" and len(got) == 3
    again = {r.vec_id: r.label for r in vector.upsert(points, new.repartition(3), order="at").collect()}
    assert again == got and vector.upsert(points, new).count() == 3
    assert dedup.newest(new, "vec_id", "at").count() == 2


def test_an_index_is_rebuilt_from_payloads(spark):
    points = spark.createDataFrame([(1, "a b a"), (2, " "), (3, None), (4, "b")], "id long, text string")
    index, stats = lexical.rebuilt(points)
    assert {(r.term, r.id): r.tf for r in index.collect()} == {("a", 1): 2, ("b", 1): 1, ("b", 4): 1} and stats.first().n == 2


def test_searches_take_a_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b c")], "query_id long, text string")
    tokens = lexical.tokenize(F.col("text"))
    lexical.save(lexical.postings(docs, tokens), lexical.corpus(docs, tokens), str(tmp_path / "i"))
    stored = lexical_search(docs, asked, SearchConfig(top_k=2), index=lexical.load(spark, str(tmp_path / "i"))).collect()
    assert stored == lexical_search(docs, asked, SearchConfig(top_k=2)).collect() and len(stored) == 2


def test_settings_tell_of_many_chunks_and_pages_end():
    assert ChunkConfig().warnings(201) == ["over 200 chunks"] and ChunkConfig().warnings(200) == []
    with pytest.raises(ValueError):
        list(rest_pages(lambda a: {"items": [1, 2]}, "page", 2, most=3))
