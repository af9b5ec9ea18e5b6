"""The query of answers moves the texts that were found alone."""

from docloom.operators import lexical
from docloom.plans.registry import QUERIES


def test_texts_stay_and_ids_are_numbers(spark, monkeypatch):
    kinds, plain = [], lexical.bm25
    monkeypatch.setattr(lexical, "bm25", lambda index, stats, queries, *a: kinds.append(queries.schema["query_id"].dataType.simpleString()) or plain(index, stats, queries, *a))
    out = QUERIES["m13_answers"](spark, "/root/testdata/sf0.001")
    assert kinds == ["bigint"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower() and out.count() > 0
