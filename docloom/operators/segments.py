"""Tables by document in immutable segments: a change writes what changes and a list of what it replaces, never what stays."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The commit that wrote a row, and the table of documents that a commit replaces or removes.
SEQ, TOUCHED = "_seq", "_touched"


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; nothing of this commit is to be seen."""


@dataclass(frozen=True)
class Segment:
    """Commits ``low`` to ``high`` as one folder; ``docs``: how many documents they touched."""

    path: str
    low: int
    high: int
    docs: int


@dataclass(frozen=True)
class Manifest:
    """The segments of a version, oldest first, and the last batch of every stream that they hold."""

    number: int = 0
    commits: int = 0
    segments: tuple[Segment, ...] = ()
    ledger: Mapping[str, int] = field(default_factory=dict)


Table = DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]


class Segments:
    """A store at ``root`` of ``tables`` (name to DDL, each with a string ``doc_id``).

    A commit writes a segment: the new rows of its documents, and which documents those replace. It counts from the moment a
    manifest names it, which is a rename that fails where another writer was first; what a lost writer leaves behind is never read. A
    manifest also holds the last batch of each stream, so that a repeated batch changes nothing.

    Rows live until a later segment touches their document: a reader joins them with the lists of later segments alone, small
    beside the store. Segments of about the same size are merged by ``fanout``, so each row is rewritten some log(n) times in all.
    """

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, str], fanout: int = 8):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.root, self.tables, self.fanout = spark, root.rstrip("/"), dict(tables), fanout
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The version that is current; an empty one where nothing was ever committed."""
        fs, folder = self._fs(), self._path("manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []
        if not names:
            return Manifest()
        stream = fs.open(self._path("manifest", names[-1]))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(found["number"], found["commits"], tuple(Segment(**s) for s in found["segments"]), found["ledger"])

    def _publish(self, m: Manifest) -> None:
        """Makes ``m`` current, or raises Conflict where its number is taken."""
        fs, new = self._fs(), self._path("manifest", f".{uuid.uuid4().hex}")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(asdict(m) | {"ledger": dict(m.ledger)}).encode()))
        finally:
            stream.close()
        try:
            rename = self._hadoop.Options.Rename
            kinds = self.spark._sc._gateway.new_array(rename, 0)
            self._hadoop.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, self._path("manifest", f"{m.number:012d}.json"), kinds)
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e).lower():
                raise Conflict(f"version {m.number} was written by another") from e
            raise

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").parquet(path)

    def _read(self, name: str, segments: tuple[Segment, ...]) -> DataFrame:
        kind = "doc_id string" if name == TOUCHED else self.tables[name]
        reader = self.spark.read.schema(f"{kind}, {SEQ} long")
        if not segments:
            return self.spark.createDataFrame([], f"{kind}, {SEQ} long")
        return reader.parquet(*[f"{self.root}/{s.path}/{name}" for s in segments])

    def _living(self, name: str, segments: tuple[Segment, ...]) -> DataFrame:
        rows = self._read(name, segments)
        if len(segments) < 2:
            return rows
        gone = self._read(TOUCHED, segments[1:]).groupBy(F.col("doc_id").alias("_doc")).agg(F.max(SEQ).alias("_last"))
        return rows.join(gone, F.col("doc_id") == F.col("_doc"), "left").where(F.col("_last").isNull() | (F.col(SEQ) >= F.col("_last"))).drop("_doc", "_last")

    def live(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """The rows of a table as the current version, or an older one that is not vacuumed, has them."""
        return self._living(name, (manifest or self.manifest()).segments).drop(SEQ)

    def commit(self, tables: Mapping[str, Table], touched: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """Adds the rows of ``tables`` in place of all rows of the documents ``touched`` (doc_id); False, and nothing is done, for a batch
        of ``stream`` that is committed already.

        A table may be a function of what this commit has written so far (name to DataFrame), so that no work is done twice. A
        table that is not named gets no rows. Null ids are refused: nothing could ever replace them.
        """
        m = self.manifest()
        if stream is not None and batch <= m.ledger.get(stream, -1):
            return False
        if unknown := set(tables) - set(self.tables):
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        number = m.commits + 1
        path = f"segments/{number:012d}-{uuid.uuid4().hex}"
        here = lambda name: self.spark.read.parquet(f"{self.root}/{path}/{name}")
        named = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("a row without doc_id")).cast("string")).otherwise(F.col("doc_id").cast("string"))
        self._write(touched.select(named.alias("doc_id")).distinct().withColumn(SEQ, F.lit(number).cast("long")), f"{self.root}/{path}/{TOUCHED}")
        for name, kind in self.tables.items():
            rows = tables.get(name, self.spark.createDataFrame([], kind))
            rows = rows(here) if callable(rows) else rows
            columns = self.spark.createDataFrame([], kind).schema
            self._write(rows.select(*[(named if f.name == "doc_id" else F.col(f.name).cast(f.dataType)).alias(f.name) for f in columns], F.lit(number).cast("long").alias(SEQ)), f"{self.root}/{path}/{name}")
        segment = Segment(path, number, number, here(TOUCHED).count())
        ledger = dict(m.ledger) | ({stream: batch} if stream is not None else {})
        self._publish(Manifest(m.number + 1, number, (*m.segments, segment), ledger))
        self.merge()
        return True

    def _run(self, segments: tuple[Segment, ...]) -> tuple[int, int] | None:
        """The newest ``fanout`` or more neighbours of one size class, as a slice; None where there are none."""
        tier = [int(math.log(max(s.docs, 1), self.fanout)) for s in segments]
        end = len(segments)
        while end:
            start = end - 1
            while start and tier[start - 1] <= tier[end - 1]:
                start -= 1
            alike = [i for i in range(start, end) if tier[i] == tier[end - 1]]
            if len(alike) >= self.fanout:
                return alike[0], end
            end -= 1
        return None

    def merge(self, everything: bool = False) -> int:
        """Merges segments until none are due, or all into one; the number of merges. Rows stay as they are to every reader."""
        done = 0
        while True:
            m = self.manifest()
            found = (0, len(m.segments)) if everything and len(m.segments) > 1 else None if everything else self._run(m.segments)
            if found is None:
                return done
            start, end = found
            old = m.segments[start:end]
            path = f"segments/{old[0].low:012d}-{uuid.uuid4().hex}"
            for name in self.tables:
                self._write(self._living(name, old), f"{self.root}/{path}/{name}")
            # what the oldest segment replaces is gone: its list is needed no more
            last = self._read(TOUCHED, old if start else ()).groupBy("doc_id").agg(F.max(SEQ).alias(SEQ))
            self._write(last, f"{self.root}/{path}/{TOUCHED}")
            merged = Segment(path, old[0].low, old[-1].high, sum(s.docs for s in old))
            self._publish(Manifest(m.number + 1, m.commits, (*m.segments[:start], merged, *m.segments[end:]), m.ledger))
            done += 1

    def vacuum(self) -> list[str]:
        """Deletes all that the current version does not name: older manifests, merged segments, what lost writers left. The paths
        that went; no reader or writer may be at work on them."""
        m, fs, gone = self.manifest(), self._fs(), []
        keep = {s.path.rsplit("/", 1)[-1] for s in m.segments}
        for folder, stays in (("segments", lambda n: n in keep), ("manifest", lambda n: n == f"{m.number:012d}.json"), ("work", lambda n: False)):
            if not fs.exists(self._path(folder)):
                continue
            for s in fs.listStatus(self._path(folder)):
                name = s.getPath().getName()
                if not stays(name) and not (folder == "manifest" and name.endswith(".crc")):
                    fs.delete(self._path(folder, name), True)
                    gone.append(f"{folder}/{name}")
        return sorted(gone)


def retried(act: Callable[[], bool], tries: int = 5) -> bool:
    """``act`` again after each Conflict, ``tries`` times in all."""
    for left in reversed(range(tries)):
        try:
            return act()
        except Conflict:
            if not left:
                raise
    raise PySparkException("no tries")
