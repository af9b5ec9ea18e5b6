"""The ingestion run: changed files become chunks, vectors, postings, a registry and a history, each batch exactly once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import chunking, text
from ..operators import cdc, lexical, vector
from ..operators.chunks import chunk_documents
from ..operators.segments import Segments
from ..sources import files

#: What comes in: one row for each changed document.
CHANGES = "change_type string, doc_id string, source_id string, path string, ext string, content binary, hash string, size long, modified timestamp"
LISTING = CHANGES.removeprefix("change_type string, ")
ADDED, MODIFIED, REMOVED = "added", "modified", "removed"
DONE, FAILED, DUPLICATE = "done", "failed", "duplicate"
TABLES = {
    "points": "id string, doc_id string, vector array<double>, source_id string, doc_path string, doc_title string, filename string, doc_type string, doc_language string, description string, keywords array<string>, "
    "chunk_index int, chunk_total int, chunk_text string, chunk_tokens long, ingestion_version string",
    "postings": "term string, id string, dl int, tf long, doc_id string",
    "registry": "doc_id string, source_id string, file_path string, file_hash string, file_size long, last_modified timestamp, text_hash string, chunk_count int, status string, error string, ingestion_version string",
    "history": "doc_id string, started_at timestamp, is_incremental boolean, total_docs long, added long, modified long, removed long, succeeded long, duplicates long, failed long, total_chunks long",
}
_VECTORS = "chunk_id string, vector array<double>, error string"


def listing_of(found: DataFrame, source_id: str) -> DataFrame:
    """The files of ``files.list_files`` as a listing."""
    docs = files.documents(found, source_id).select(F.col("file_path").alias("rel"), "id", "source_id", F.col("content_hash").alias("hash"))
    return found.join(docs, "rel").select(F.col("id").alias("doc_id"), "source_id", F.col("rel").alias("path"), "ext", "content", "hash", F.col("size"), F.col("modified"))


def _embedded(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int) -> DataFrame:
    """(chunk_id, vector, error): texts go to ``embedder`` ``batch`` at a time; where one fails each goes alone, and who fails alone has an error."""

    def one(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = [list(map(float, v)) for v in embedder(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors of {len(texts)} texts")
            return [(v, None) for v in vectors]
        except Exception as e:  # whatever a service may raise
            return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [one([t])[0] for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple[list[float] | None, str | None]] = []
            for at in range(0, len(frame), batch):
                found += one(frame["content"].iloc[at : at + batch].tolist())
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "vector": [v for v, _ in found], "error": [e for _, e in found]})

    return chunks.select("chunk_id", "content").mapInPandas(run, _VECTORS)


class Ingestion:
    """Keeps the tables of a collection at ``root``: points (chunks with vectors), postings, registry, history.

    A batch of changes is applied as one commit of a segment store: readers see all of its tables or none. The store remembers the
    last batch of each stream, so a batch that Spark repeats after a failure changes nothing; a batch that broke
    off before its commit left nothing that is read, and is done anew.

    A document that cannot be read or embedded is registered with no chunks and its error, and fails no other; it is tried again when it
    changes. One whose text equals that of a document of a smaller id in its batch, or of any that was there before, is registered as a duplicate without
    chunks (``dedup``). Chunks are of the text as it was read. ``embedder`` takes a list of texts; without one vectors are hashed words.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        config: chunking.ChunkConfig | None = None,
        dimensions: int = 256,
        embedder: Callable[[list[str]], list[list[float]]] | None = None,
        batch: int = 32,
        dedup: bool = True,
        now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
        fanout: int = 8,
    ):
        self.spark, self.config, self.dimensions, self.embedder, self.batch, self.dedup, self.now = spark, config or chunking.ChunkConfig(), dimensions, embedder, batch, dedup, now
        self.store = Segments(spark, root, TABLES, fanout)

    def points(self) -> DataFrame:
        return self.store.live("points")

    def postings(self) -> DataFrame:
        return self.store.live("postings")

    def registry(self) -> DataFrame:
        return self.store.live("registry")

    def history(self) -> DataFrame:
        """A row for each run, ``doc_id`` holding its version."""
        return self.store.live("history").withColumnRenamed("doc_id", "version")

    def index(self) -> tuple[DataFrame, DataFrame]:
        """Postings and corpus figures for lexical.bm25: ids are those of chunks."""
        sizes = self.points().select(F.size(lexical.tokenize(F.col("chunk_text"), F.col("doc_language"))).alias("dl"))
        stats = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).select("n", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("avgdl"))
        return self.postings().drop("doc_id"), stats

    def _staged(self, rows: DataFrame, name: str, work: str) -> DataFrame:
        """What follows reads ``rows`` from files: a document is read and embedded once."""
        rows.write.parquet(f"{work}/{name}")
        return self.spark.read.parquet(f"{work}/{name}")

    def _read(self, changes: DataFrame) -> DataFrame:
        """The last change of each document, with the text of those that are there."""
        order = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("modified"), F.desc("change_type"), F.desc_nulls_last("hash"))
        last = changes.select(*[c.split()[0] for c in CHANGES.split(", ")]).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        there = F.col("change_type") != REMOVED
        got = F.when(there & F.col("content").isNotNull(), files.parsed(F.coalesce("content", F.lit(b"")), F.coalesce("ext", F.lit(""))))
        docs = last.withColumn("p", got).select("*", F.col("p.text").alias("text"), F.when(there & F.col("content").isNull(), "no content").otherwise(F.col("p.error")).alias("error"))
        return docs.drop("p", "content").withColumn("text_hash", F.sha2("text", 256))

    def _kept(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``status``: failed, duplicate, or null for those to be chunked."""
        docs = docs.withColumn("status", F.when(F.col("error").isNotNull(), FAILED))
        if not self.dedup:
            return docs
        fresh = docs.where("change_type <> 'removed' and status is null")
        before = self.registry().join(docs.select("doc_id"), "doc_id", "left_anti").where(F.col("status") == DONE).select("text_hash")
        twins = fresh.groupBy("text_hash").agg(F.min("doc_id").alias("first")).join(before.distinct().withColumn("known", F.lit(True)), "text_hash", "left")
        out = docs.join(twins, "text_hash", "left")
        again = (F.col("change_type") != REMOVED) & F.col("status").isNull() & (F.col("known").isNotNull() | (F.col("doc_id") != F.col("first")))
        return out.withColumn("status", F.when(again, DUPLICATE).otherwise(F.col("status"))).drop("first", "known")

    def apply(self, changes: DataFrame, stream: str | None = None, batch: int = 0, incremental: bool = True) -> bool:
        """Applies a batch of CHANGES; False where the store has it already. Of several changes of a document the last by ``modified`` counts, of
        equal times a removal first. A removal of what is not there does nothing; a batch without rows still is a run."""
        manifest = self.store.manifest()
        if stream is not None and batch <= manifest.ledger.get(stream, -1):
            return False
        started, version, work = self.now(), f"v{manifest.commits + 1}", f"{self.store.root}/work/{uuid.uuid4().hex}"
        docs = self._staged(self._kept(self._staged(self._read(changes), "read", work)), "docs", work)
        there = docs.where("change_type <> 'removed'")
        chunks = chunk_documents(there.where("status is null"), self.config)
        if self.embedder:
            chunks = self._staged(chunks, "chunks", work)
            vectors = self._staged(_embedded(chunks, self.embedder, self.batch), "vectors", work)
            bad = chunks.join(vectors.where("error is not null").select("chunk_id", "error"), "chunk_id").groupBy("doc_id").agg(F.min("error").alias("failure"))
            chunks = chunks.join(vectors.where("error is null").select("chunk_id", "vector"), "chunk_id").join(bad, "doc_id", "left_anti")
            there = there.join(bad, "doc_id", "left").withColumn("status", F.when(F.col("failure").isNotNull(), FAILED).otherwise(F.col("status"))).withColumn("error", F.coalesce("error", "failure")).drop("failure")
        else:
            chunks = chunks.withColumn("vector", vector.l2_normalize(vector.hashed_vector(text.words(F.col("content")), self.dimensions)))
        filename = F.regexp_extract("path", r"([^/]*)$", 1)
        words = text.keywords(there.where("status is null").select("doc_id", "text"))
        about = there.select("doc_id", "source_id", F.col("path").alias("doc_path"), text.title(filename).alias("doc_title"), filename.alias("filename"), F.col("ext").alias("doc_type"), text.detect_language(F.col("text")).alias("doc_language"), text.description(F.col("text")).alias("description")).join(words, "doc_id", "left")
        total = F.count("*").over(Window.partitionBy("doc_id")).cast("int")
        points = chunks.withColumn("chunk_total", total).join(about, "doc_id").select("*", F.col("chunk_id").alias("id"), F.col("content").alias("chunk_text"), F.col("tokens").alias("chunk_tokens"), F.lit(version).alias("ingestion_version"))

        def postings(here: Callable[[str], DataFrame]) -> DataFrame:
            found = here("points")
            terms = lexical.postings(found, lexical.tokenize(F.col("chunk_text"), F.col("doc_language")), "id")
            return terms.join(found.select("id", "doc_id"), "id")

        def registry(here: Callable[[str], DataFrame]) -> DataFrame:
            counts = here("points").groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
            out = there.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
            status = F.coalesce("status", F.lit(DONE))
            return out.select("doc_id", F.coalesce("source_id", F.lit("default")).alias("source_id"), F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.col("size").alias("file_size"), F.col("modified").alias("last_modified"), "text_hash", "chunk_count", status.alias("status"), "error", F.lit(version).alias("ingestion_version"))

        def history(here: Callable[[str], DataFrame]) -> DataFrame:
            kinds = docs.agg(F.count("*").alias("total_docs"), *[F.count_if(F.col("change_type") == k).alias(k) for k in (ADDED, MODIFIED, REMOVED)])
            ends = here("registry").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in ((DONE, "succeeded"), (DUPLICATE, "duplicates"), (FAILED, "failed"))], F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"))
            return kinds.crossJoin(F.broadcast(ends)).select(F.lit(version).alias("doc_id"), F.lit(started).alias("started_at"), F.lit(incremental).alias("is_incremental"), "*")

        done = self.store.commit({"points": points, "postings": postings, "registry": registry, "history": history}, docs.select("doc_id"), stream, batch)
        folder = self.store._path("work", work.rsplit("/", 1)[1])
        self.store._fs().delete(folder, True)
        return done

    def changes(self, listing: DataFrame, sources: list[str] | None = None) -> DataFrame:
        """CHANGES of a whole listing of ``sources`` (all of the registry by default) against the registry, by hash."""
        known = self.registry()
        if sources is not None:
            known, listing = known.where(F.col("source_id").isin(sources)), listing.where(F.col("source_id").isin(sources))
        found = cdc.changes(listing.select(F.col("doc_id").alias("id"), "hash"), known.select(F.col("doc_id").alias("id"), F.coalesce("file_hash", F.lit("")).alias("hash"))).withColumnRenamed("id", "doc_id")
        return found.join(listing, "doc_id", "left").select(*[c.split()[0] for c in CHANGES.split(", ")])

    def run(self, listing: DataFrame, sources: list[str] | None = None, full: bool = False, stream: str | None = None, batch: int = 0) -> bool:
        """Applies what a whole listing changes, removals included; ``full`` takes every document as changed."""
        found = self.changes(listing, sources)
        if full:
            same = listing.join(found.select("doc_id"), "doc_id", "left_anti").withColumn("change_type", F.lit(MODIFIED))
            found = found.unionByName(same.select(found.columns))
        return self.apply(found, stream, batch, incremental=not full)

    def start(self, changes: DataFrame, checkpoint: str, name: str, trigger: dict | None = None) -> StreamingQuery:
        """Applies a stream of CHANGES; after a restart from ``checkpoint`` no batch counts twice. ``name`` keeps streams apart."""
        sink = changes.writeStream.foreachBatch(lambda rows, n: self.apply(rows, name, n)).option("checkpointLocation", checkpoint)
        return sink.trigger(**(trigger or {"availableNow": True})).start()

    def watch(self, listing: Callable[[], DataFrame], checkpoint: str, name: str, seconds: int = 30, sources: list[str] | None = None) -> StreamingQuery:
        """Lists anew every ``seconds`` and applies what has changed."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(lambda _, n: self.run(listing(), sources, stream=name, batch=n)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
