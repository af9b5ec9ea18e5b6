"""Segments and the ingestion run: whatever breaks off, the tables are those of an unbroken run."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from docloom.functions.chunking import ChunkConfig
from docloom.operators import lexical
from docloom.operators.segments import Conflict, Segments, retried
from docloom.sources import files
from docloom.streaming import ingestion
from docloom.streaming.ingestion import Ingestion

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
CONFIG = ChunkConfig("sentence_based", chunk_size=8, chunk_overlap=0, min_chunk_size=1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, v int")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "doc_id string")


def test_segments_equal_a_dict_after_any_order_of_changes(spark, tmp_path):
    store = Segments(spark, str(tmp_path), {"t": "doc_id string, v int", "u": "doc_id string, v int"}, fanout=2)
    assert store.live("t").count() == 0 and store.merge() == 0
    rnd, want = random.Random(1), {}
    for n in range(7):
        names = [str(i) for i in rnd.sample(range(10), rnd.randint(1, 4))]
        new = [x for x in names if rnd.random() < 0.7]
        for x in names:
            want.pop(x, None)
        want |= dict.fromkeys(new, n)
        assert store.commit({"t": frame(spark, [(x, n) for x in new] * 2), "u": lambda here: here("t").select("doc_id", (F.col("v") + 1).alias("v"))}, ids(spark, names), "s", n)
        assert sorted(map(tuple, store.live("t").collect())) == sorted([*want.items()] * 2)
        assert len(store.manifest().segments) <= 6
    assert sorted({(r.doc_id, r.v - 1) for r in store.live("u").collect()}) == sorted(want.items())
    before = store.manifest()
    assert not store.commit({}, ids(spark, want), "s", 3) and store.manifest() == before
    assert store.merge(everything=True) == 1 and len(store.manifest().segments) == 1
    assert len(store.vacuum()) > 0 and {(r.doc_id, r.v) for r in store.live("t").collect()} == set(want.items())


def test_a_small_change_writes_little(spark, tmp_path):
    store = Segments(spark, str(tmp_path), {"t": "doc_id string, v int"})
    store.commit({"t": spark.range(10_000).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("v"))}, spark.range(10_000).select(F.col("id").alias("doc_id")))
    big = store.manifest().segments[0]
    store.commit({"t": spark.range(100).select(F.col("id").cast("string").alias("doc_id"), F.lit(1).alias("v"))}, spark.range(100).select(F.col("id").alias("doc_id")))
    now = store.manifest().segments
    assert now[0] == big and spark.read.parquet(f"{tmp_path}/{now[1].path}/t").count() == 100
    assert store.live("t").agg(F.sum("v"), F.count("*")).first()[:] == (100, 10_000)


def test_rows_are_rewritten_log_times(spark, tmp_path):
    store, merges = Segments(spark, str(tmp_path), {"t": "doc_id string"}, fanout=3), []
    store._write = lambda rows, path: None
    sizes = [1] * 30
    from docloom.operators.segments import Segment

    segments, written = [], 0
    for n, size in enumerate(sizes):
        segments.append(Segment("", n, n, size))
        written += size
        while (run := store._run(tuple(segments))) is not None:
            merged = segments[run[0] : run[1]]
            written += sum(s.docs for s in merged)
            segments[run[0] : run[1]] = [Segment("", merged[0].low, merged[-1].high, sum(s.docs for s in merged))]
            merges.append(run)
    assert written <= 30 * 5 and len(segments) <= 9 and sum(s.docs for s in segments) == 30


def test_a_second_writer_gets_a_conflict(spark, tmp_path):
    one, two = (Segments(spark, str(tmp_path), {"t": "doc_id string, v int"}) for _ in range(2))
    one.commit({"t": frame(spark, [("a", 1)])}, ids(spark, ["a"]))
    late = two.manifest()
    one.commit({"t": frame(spark, [("a", 2)])}, ids(spark, ["a"]))
    fresh, two.manifest = two.manifest, lambda: late
    with pytest.raises(Conflict):
        two.commit({"t": frame(spark, [("a", 3)])}, ids(spark, ["a"]))
    assert [r.v for r in one.live("t").collect()] == [2]
    calls = iter([lambda: late, fresh])

    def again():
        two.manifest = next(calls)
        return two.commit({"t": frame(spark, [("a", 3)])}, ids(spark, ["a"]))

    assert retried(again) and [r.v for r in one.live("t").collect()] == [3]
    with pytest.raises(Exception, match="without doc_id"):
        one.commit({"t": frame(spark, [(None, 1)])}, ids(spark, ["b"]))
    with pytest.raises(ValueError, match="unknown"):
        one.commit({"x": frame(spark, [])}, ids(spark, ["b"]))


def batches(spark):
    """Three batches: added with a bad file and twins; modified, removed and a file that is bad now; a late repeat and a return."""
    rows = [
        [("added", "a", "One two three. Four five six seven eight nine."), ("added", "b", "{", "json"), ("added", "c", "Same text here."), ("added", "d", "Same text here."), ("added", "e", "")],
        [("modified", "a", "New words now."), ("removed", "c", None), ("modified", "b", '{"x": 1}', "json"), ("removed", "zz", None), ("modified", "a", "Older words.", "txt", -5)],
        [("added", "c", "Back again. And more of it."), ("modified", "e", None), ("added", "f", "New words now.")],
    ]
    out = []
    for n, batch in enumerate(rows):
        made = []
        for kind, name, content, *more in batch:
            ext, shift = (more + ["txt", 0][len(more) :])[:2]
            raw = content.encode() if content is not None else None
            made.append((kind, name, "s", f"dir/{name}.{ext}", ext, raw, f"h{n}{name}{shift}", len(raw or b""), datetime(2026, 1, 2 + n, tzinfo=timezone.utc).replace(minute=30 + shift)))
        out.append(spark.createDataFrame(made, ingestion.CHANGES))
    return out


def tables(run):
    return {
        "points": sorted((r.doc_id, r.chunk_index, r.chunk_total, r.chunk_text, tuple(r.vector), r.doc_title, r.ingestion_version) for r in run.points().collect()),
        "postings": sorted((r.term, r.id, r.dl, r.tf) for r in run.postings().collect()),
        "registry": sorted(map(str, run.registry().collect())),
        "history": sorted(map(str, run.history().collect())),
    }


def make(spark, root, **more):
    return Ingestion(spark, str(root), CONFIG, dimensions=16, now=lambda: NOW, fanout=2, **more)


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    run = make(spark, tmp_path_factory.mktemp("unbroken"))
    for n, b in enumerate(batches(spark)):
        assert run.apply(b, "s", n)
    return run


def test_documents_chunks_failures_and_removals(unbroken):
    reg = {r.doc_id: r for r in unbroken.registry().collect()}
    assert {k: (r.status, r.chunk_count) for k, r in reg.items()} == {"a": ("done", 1), "b": ("done", 1), "c": ("done", 1), "d": ("duplicate", 0), "e": ("failed", 0), "f": ("duplicate", 0)}
    assert reg["e"].error == "no content" and reg["a"].ingestion_version == "v2" and reg["d"].ingestion_version == "v1"
    assert {r.doc_id: r.chunk_text for r in unbroken.points().collect()}["a"] == "New words now."
    hist = {r.version: r for r in unbroken.history().collect()}
    assert (hist["v1"].total_docs, hist["v1"].failed, hist["v1"].duplicates, hist["v1"].succeeded) == (5, 1, 1, 3)
    assert (hist["v2"].modified, hist["v2"].removed, hist["v3"].added) == (2, 2, 2)
    index, stats = unbroken.index()
    queries = index.sparkSession.createDataFrame([(1, ["words"])], "query_id int, ts array<string>")
    assert lexical.bm25(index, stats, queries).count() == 1


def test_killed_between_any_two_writes_it_ends_as_unbroken(spark, unbroken, tmp_path):
    want, parts = tables(unbroken), batches(spark)
    run = make(spark, tmp_path / "broken")

    class Killed(RuntimeError):
        pass

    real_write, real_publish, kills = run.store._write, run.store._publish, 0
    for n, part in enumerate(parts):
        for at in range(0, 40, 3):  # dies at its at-th write, each time anew, until a run gets through
            left = [at]

            def die(act, left=left):
                def f(*a):
                    if left[0] == 0:
                        raise Killed
                    left[0] -= 1
                    act(*a)

                return f

            run.store._write, run.store._publish = die(real_write), die(real_publish)
            try:
                run.apply(part, "s", n)
                break
            except Killed:
                kills += 1
        run.store._write, run.store._publish = real_write, real_publish
        assert not run.apply(part, "s", n)
    assert kills >= 6
    run.store.merge()
    run.store.vacuum()
    assert tables(run) == want


def test_a_stream_that_is_stopped_and_started_counts_no_batch_twice(spark, unbroken, tmp_path):
    for n, b in enumerate(batches(spark)):
        b.coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = lambda: spark.readStream.schema(ingestion.CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run, calls = make(spark, tmp_path / "store"), []
    real = run.store.commit

    def once_lost(*a):  # the second batch is committed, but Spark never hears of it
        done = real(*a)
        calls.append(a[3])
        if calls == [0, 1]:
            raise RuntimeError("lost")
        return done

    run.store.commit = once_lost
    with pytest.raises(Exception, match="lost"):
        run.start(stream(), str(tmp_path / "checkpoint"), "s").awaitTermination(120)
    run.start(stream(), str(tmp_path / "checkpoint"), "s").awaitTermination(120)
    assert calls == [0, 1, 2] and run.store.manifest().ledger == {"s": 2}
    assert tables(run) == tables(unbroken)


def test_a_listing_finds_its_changes(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_text("First file of all.")
    (folder / "b.json").write_text("{")
    run = make(spark, tmp_path / "store")
    listing = lambda: ingestion.listing_of(files.list_files(spark, str(folder)), "s")
    assert run.run(listing()) and run.changes(listing()).count() == 0  # the failed one is known too
    (folder / "a.txt").write_text("Changed.")
    (folder / "b.json").write_text(json.dumps({"k": 1}))
    (folder / "c.txt").write_text("Third.")
    kinds = {r.path: r.change_type for r in run.changes(listing()).collect()}
    assert kinds == {"a.txt": "modified", "b.json": "modified", "c.txt": "added"}
    run.run(listing())
    (folder / "a.txt").unlink()
    assert run.changes(listing(), ["other"]).count() == 0
    run.run(listing())
    assert {r.file_path: r.status for r in run.registry().collect()} == {"b.json": "done", "c.txt": "done"}
    run.run(listing(), full=True)
    assert {r.version: r.is_incremental for r in run.history().collect()} == {"v1": True, "v2": True, "v3": True, "v4": False}
    assert {r.ingestion_version for r in run.points().collect()} == {"v4"}


def test_one_failing_text_fails_its_document_alone(spark, tmp_path):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    run = make(spark, tmp_path, embedder=embedder)
    rows = [("added", "a", "s", "a.txt", "txt", b"Good one here.", "h", 1, NOW), ("added", "b", "s", "b.txt", "txt", b"First is good enough for us. Then one bad thing comes along now.", "h", 1, NOW)]
    run.apply(spark.createDataFrame(rows, ingestion.CHANGES))
    reg = {r.doc_id: r for r in run.registry().collect()}
    assert reg["a"].status == "done" and reg["b"].status == "failed" and "refused" in reg["b"].error and reg["b"].chunk_count == 0
    assert [tuple(r.vector) for r in run.points().collect()] == [(14.0, 1.0)]
