"""Monitoring, change detection, deduplication, contexts, sources and streams."""

import pandas as pd
from pyspark.sql import functions as F

from docloom.operators import cdc, context, dedup, monitoring
from docloom.sources import files, records, web
from docloom.streaming import streams

NOW = "2024-01-31 00:00:00"


def _log(spark, latencies, feedback=None):
    rows = [(i, ms, True, (feedback or [None] * 9)[i]) for i, ms in enumerate(latencies)]
    return spark.createDataFrame(rows, "id int, total_latency_ms int, success boolean, feedback string").withColumn("ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).withColumn("cost", F.lit(0.1))


def test_metrics(spark):
    got = monitoring.metrics(_log(spark, [100, 200, 300, 400, 0]), NOW).first()
    assert (got.avg_latency_ms, got.p95_latency_ms, got.negative_feedback_rate) == (250, 385, 0.0)
    none = monitoring.metrics(_log(spark, []), NOW)
    assert none.first().success_rate == 0.0 and none.first().avg_latency_ms == 0
    assert monitoring.alerts(none).count() == 0


def test_rotation(spark):
    log = _log(spark, [1] * 9)
    assert monitoring.rotate(log, 9).count() == 9 and monitoring.rotate(log, 5).count() == 4


def test_changes(spark):
    kind = "id string, hash string"
    cur = spark.createDataFrame([("x", "h1"), ("y", "h9"), ("w", "h4")], kind)
    known = spark.createDataFrame([("x", "h1"), ("y", "h2"), ("z", "h3")], kind)
    assert {(r.change_type, r.id) for r in cdc.changes(cur, known).collect()} == {("added", "w"), ("modified", "y"), ("removed", "z")}
    assert cdc.changes(cur, cur).count() == 0


def test_fuzzy_is_sequential(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (3, "c d e"), (4, "..."), (5, "")], "doc_id int, text string")
    assert sorted(r.doc_id for r in dedup.fuzzy(docs, F.col("text"), 0.5).collect()) == [1, 3, 4]


def test_fuzzy_equals_the_loop(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 7)))) for i in range(80)]
    for t in (0.5, 0.8):
        kept = []
        for i, x in rows:
            s = set(x.split())
            if all(len(s & k) / len(s | k) < t for _, k in kept):
                kept.append((i, s))
        got = dedup.fuzzy(spark.createDataFrame(rows, "doc_id int, text string"), F.col("text"), t)
        assert sorted(r.doc_id for r in got.collect()) == [i for i, _ in kept]


def test_context_budget(spark):
    def used(sizes):
        rows = [(1, k + 1, " ".join(["w"] * n), 0.5) for k, n in enumerate(sizes)]
        out = context.assemble(spark.createDataFrame(rows, "query_id int, rank int, text string, score double"), 5, 500)
        return [(r.tokens, r.truncated) for r in out.orderBy("rank").collect()]

    assert used([300, 100, 200, 10]) == [(300, False), (100, False), (100, True)]
    assert used([300, 160, 200]) == [(300, False), (160, False)]


def test_history_and_summary(spark):
    msgs = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(4)], "conv_id int, turn int, role string, text string")
    assert context.format_history(msgs, 2).first().history == "Utilisateur: m2\nAssistant: m3"
    out = context.with_summary(msgs, spark.createDataFrame([(1, "s")], "conv_id int, summary string"), 2)
    assert [r.role for r in out.orderBy("turn").collect()] == ["system", "user", "assistant"]


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "skip").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes("é".encode("cp1252"))
    (tmp_path / "sub" / "b.yml").write_text("x: 1")
    (tmp_path / "sub" / "skip" / "c.txt").write_text("c")
    (tmp_path / "~$d.txt").write_text("d")
    (tmp_path / "bad.json").write_text("{")
    found = files.list_files(spark, str(tmp_path), excluded_dirs=("sub/skip",))
    assert {r.rel for r in found.select("rel").collect()} == {"a.txt", "sub/b.yml", "bad.json"}
    read = {r.rel: r.p for r in found.select("rel", files.parsed("content", "ext").alias("p")).collect()}
    assert read["a.txt"].text == "é" and read["a.txt"].encoding == "cp1252" and read["bad.json"].error
    tree = {r.folder: r.files for r in files.folder_tree(found).collect()}
    assert tree == {"": 3, "sub": 1}


def test_web(spark):
    pages = spark.createDataFrame([("http://a/", '<a href="/x#f">x</a><a href="mailto:q">m</a><a href="http://b/">b</a>'), ("http://a/x", '<title>T</title><h1>H</h1><a href="/y">y</a>'), ("http://a/y", "y"), ("http://b/", "b")], "url string, html string")
    start = spark.createDataFrame([("http://a/",)], "url string")
    assert {(r.url, r.depth) for r in web.crawl(pages, start, 2).collect()} == {("http://a/", 0), ("http://a/x", 1), ("http://a/y", 2)}
    assert web.crawl(pages, start, 1, same_domain=False).count() == 3
    assert pages.where("url = 'http://a/x'").select(web.markdown("html")).first()[0] == "# H\ny"


def test_records(spark):
    spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string").createOrReplaceTempView("docloom_rows")
    got = records.from_query(spark, "SELECT k, v FROM docloom_rows", "s", "k", "v").collect()
    assert [(r.id, r.title, r.content) for r in got] == [("1", "Row 1", "a")]
    try:
        records.from_query(spark, "DROP VIEW docloom_rows", "s", "k", "v")
        raise AssertionError("a statement went through")
    except ValueError:
        pass
    pages = [{"items": [1, 2], "next": "c"}, {"items": [3]}]
    assert sum(len(p["items"]) for p in records.rest_pages(lambda a: pages[1] if a.get("cursor") else pages[0], "cursor", 2)) == 3
    feed = "<rss><channel><item><guid>g</guid><title>t</title></item><item><title>u</title></item></channel></rss>"
    assert [e["id"] for e in records.feed_entries(feed)] == ["g", "u"]
    assert records.notion_text([{"type": "heading_1", "heading_1": {"rich_text": [{"plain_text": "A"}]}}, {"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "b"}]}}]) == "# A\n\nb"


def test_tree_source(spark):
    import json

    spark.dataSource.register(records.TreeSource)
    tree = {"f": [{"id": "1", "name": "n", "content": "c", "modified": "m"}], "g": [{"id": "2"}]}
    rows = spark.read.format("docloom_tree").option("tree", json.dumps(tree)).load()
    assert {r.id for r in rows.collect()} == {"drive:1", "drive:2"}


def test_debounce():
    d = streams.Debounce(10)
    assert [d.observe(s, t) for s, t in (("a", 0), ("a", 5), ("b", 6), ("b", 15), ("b", 16), ("", 17))] == ["waiting", "waiting", "waiting", "waiting", "fire", "idle"]
    assert streams.eta_seconds([2.0, 4.0], 3) == 9.0


def test_debounced_stream(spark, tmp_path):
    pd.DataFrame({"source": ["s"] * 3, "signature": ["a", "a", "a"], "at": [0.0, 4.0, 31.0]}).to_parquet(tmp_path / "x.parquet")
    watch = spark.readStream.schema("source string, signature string, at double").parquet(str(tmp_path))
    run = streams.debounced(watch).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.source, r.at) for r in spark.table("fired").collect()] == [("s", 31.0)]


def test_versions(spark, tmp_path):
    from docloom.operators import stores

    path, rows = str(tmp_path / "store"), spark.range(3)
    assert stores.versions(spark, path) == [] and stores.commit(rows, path) == "v1" and stores.commit(rows.limit(1), path) == "v2"
    assert stores.load(spark, path).count() == 1
    stores.point(spark, path, "v1")
    assert stores.current(spark, path) == "v1" and stores.load(spark, path).count() == 3


def test_analysis_and_messages(spark):
    from docloom.operators import agents

    rows = spark.createDataFrame([('```json\n{"intent": " Greeting ", "confidence": 2}\n```',), ("no json",), (None,)], "a string")
    got = [tuple(r.x) for r in rows.select(agents.parse_analysis(F.col("a")).alias("x")).collect()]
    assert got == [("greeting", 1.0, False), ("question", 0.5, True), ("question", 0.5, True)]
    h = F.expr("array(named_struct('role', 'User', 'content', 'x'), named_struct('role', 'tool', 'content', 'y'))")
    m = spark.range(1).select(agents.messages(F.lit("s"), h, F.lit("c"), F.lit("q"), "en").alias("m")).first().m
    assert [(x.role, x.content) for x in m] == [("system", "s"), ("user", "x"), ("user", "c\n\nQuestion : q\nAnswer in English.")]
    out = agents.generate(spark.createDataFrame([(1, "p")], "query_id int, prompt string"), lambda ps: 1 / 0).first()
    assert out.answer is None and out.error.startswith("ZeroDivisionError")
