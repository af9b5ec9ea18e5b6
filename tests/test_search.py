"""Search against literal figures."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import fusion, lexical, vector

CORPUS = [("d1", "cat sat mat"), ("d2", "cat cat dog"), ("d3", "dog ran far away")]


def _bm25(spark, query, delta=0.0):
    docs = spark.createDataFrame(CORPUS, "doc_id string, text string")
    ts = lexical.tokenize(F.col("text"))
    asked = spark.createDataFrame([(1, query)], "query_id int, text string").select("query_id", lexical.tokenize(F.col("text")).alias("ts"))
    return {r.id: r.score for r in lexical.bm25(lexical.postings(docs, ts), lexical.corpus(docs, ts), asked, delta=delta).collect()}


def test_bm25(spark):
    assert _bm25(spark, "cat dog") == {"d2": 1.185883, "d1": 0.492150, "d3": 0.431196}
    assert _bm25(spark, "cat dog", 0.5) == {"d2": 1.655886, "d1": 0.727152, "d3": 0.666198}
    assert _bm25(spark, "cat cat") == {"d2": 1.387465, "d1": 0.984301}
    assert _bm25(spark, "zebra") == {} and _bm25(spark, "") == {}


def _sides(spark):
    kind = "query_id int, id string, score double"
    return spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7)], kind), spark.createDataFrame([(1, "b", 12.0), (1, "d", 6.0)], kind)


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({}, {"b": 0.016261, "a": 0.008197, "d": 0.008065, "c": 0.007937}),
        ({"alpha": 0.3}, {"b": 0.016314, "d": 0.01129, "a": 0.004918, "c": 0.004762}),
        ({"method": "weighted"}, {"b": 0.75, "a": 0.5, "c": 0.0, "d": 0.0}),
        ({"method": "weighted", "normalization": "z_score"}, {"a": 0.612372, "b": 0.5}),
    ],
)
def test_fusion(spark, options, expected):
    rows = fusion.fuse(*_sides(spark), **options).orderBy("rank").collect()
    assert {r.id: r.score for r in rows} == expected
    assert [r.id for r in rows] == list(expected)


def test_mmr_takes_what_differs(spark):
    rows = [(1, "a", 0.90, [1.0, 0.0]), (1, "b", 0.88, [0.99, 0.141067]), (1, "c", 0.60, [0.6, 0.8])]
    out = vector.mmr(spark.createDataFrame(rows, "query_id int, id string, score double, vector array<double>"), 3)
    assert [r.id for r in out.orderBy("pick").collect()] == ["a", "c", "b"]


def test_hashed_embedding(spark):
    docs = spark.createDataFrame([(1, "Chat été chat"), (2, "")], "doc_id int, text string")
    got = {r.doc_id: r.vector for r in vector.hashed_embedding(docs, 8).collect()}
    assert got[1] == pytest.approx([0, 0, 0.937043, -0.312348, 0, 0, 0, 0.156174], abs=1e-6)
    assert got[2] == [0.0] * 8


def test_filters_merge():
    a, b = fusion.Filters(languages=["fr", "en"]), fusion.Filters(languages=["en", "de"], doc_ids=["1"])
    assert a.merge(b) == fusion.Filters(languages=["en"], doc_ids=["1"]) and a.merge(None) == a
    assert a.merge(fusion.Filters(languages=["de"])).languages == []


def test_knn_on_all_metrics(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, vector array<double>")
    best = {m: [r.vec_id for r in vector.knn(pts, q, 3, m).orderBy("rank").collect()] for m in vector.METRICS}
    assert best == {"cosine": [1, 2, 3], "dot": [2, 1, 3], "euclidean": [1, 2, 3]}


def test_knn_of_many_queries(spark, monkeypatch):
    pts = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    q = pts.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = {tuple(r) for r in vector.knn(pts, q, 4).collect()}
    monkeypatch.setattr(vector, "BLOCK", 25)
    assert {tuple(r) for r in vector.knn(pts, q, 4).collect()} == want and len(want) == 240
    assert vector.knn(pts, q.where("false"), 4).count() == 0


def test_rerank_and_multi_query(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.9, 0.2), (1, "b", 2, 0.8, 0.7), (1, "c", 3, 0.1, None)], "query_id int, id string, rank int, score double, s double")
    out = fusion.rerank(rows, F.col("s")).orderBy("rank").collect()
    assert [(r.id, r.rank_change) for r in out] == [("b", 1), ("a", -1), ("c", 0)]
    merged = fusion.merge_queries(spark.createDataFrame([(1, "a", 0.1), (1, "a", 0.5), (1, None, 0.9), (1, "b", 0.3)], "query_id int, id string, score double"))
    assert [r.id for r in merged.orderBy("rank").collect()] == ["a", "b", None]


def test_highlights(spark):
    rows = spark.createDataFrame([("Cats and a cat, concat", ["cat"])], "t string, terms array<string>")
    spans = rows.select(lexical.highlights("t", "terms").alias("h")).first().h
    assert [(s.start, s.end) for s in spans] == [(0, 4), (11, 14)]
