"""Tables of a database as documents: partitioned reads over JDBC that go on from the last mark."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256_id
from ..operators.cut import cut
from ..operators.segments import Segments

SEEN = "doc_id string, mark string, hash string"


@dataclass(frozen=True)
class SqlSource:
    """``query``: a table or a SELECT. ``mark_column`` grows with every change, as a time of change or a counter does; ``partition_column``, a number or time,
    splits a read into ``partitions`` tasks, each with a range of its own."""

    url: str
    query: str
    source_id: str
    id_column: str
    content_column: str
    title_column: str | None = None
    mark_column: str | None = None
    metadata_columns: tuple[str, ...] = ()
    partition_column: str | None = None
    partitions: int = 8
    fetch_size: int = 10_000
    properties: Mapping[str, str] = field(default_factory=dict)

    def _reader(self, spark: SparkSession, query: str):
        return spark.read.format("jdbc").options(url=self.url, fetchsize=str(self.fetch_size), **self.properties).option("dbtable", query)

    @property
    def _from(self) -> str:
        return f"({self.query.strip().rstrip(';')}) docloom_rows" if " " in self.query.strip() else self.query

    def rows(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        """The table's own rows, from mark ``since`` on and those without a mark; that condition and the columns go to the database."""
        plain = self._reader(spark, self._from)
        names = list(dict.fromkeys([self.id_column, self.content_column, *[c for c in (self.title_column, self.mark_column) if c], *self.metadata_columns]))

        def newer(rows: DataFrame) -> DataFrame:
            if since is None or not self.mark_column:
                return rows
            kind = rows.schema[self.mark_column].dataType
            return rows.where((F.col(self.mark_column) >= F.lit(since).cast(kind)) | F.col(self.mark_column).isNull())

        if self.partition_column:
            p = F.col(self.partition_column)
            low, high = newer(plain.load()).agg(F.min(p).cast("string"), F.max(p).cast("string")).first()
            if low is not None and low != high:
                plain = plain.options(partitionColumn=self.partition_column, lowerBound=low, upperBound=high, numPartitions=str(self.partitions))
        return newer(plain.load()).select(*names)

    def documents(self, rows: DataFrame) -> DataFrame:
        """(id, source_id, title, content, file_path, metadata, last_modified, content_hash): rows without an id go, a missing title is "Row <id>", a missing content is empty."""
        key, text = F.col(self.id_column).cast("string"), F.coalesce(F.col(self.content_column).cast("string"), F.lit(""))
        title = F.coalesce(F.col(self.title_column).cast("string") if self.title_column else F.lit(None).cast("string"), F.concat(F.lit("Row "), key))
        pairs = [x for c in self.metadata_columns for x in (F.lit(c), F.col(c).cast("string"))]
        metadata = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
        mark = F.col(self.mark_column).cast("string") if self.mark_column else F.lit(None).cast("string")
        out = rows.where(F.col(self.id_column).isNotNull())
        return out.select(sha256_id(F.lit(self.source_id), key).alias("id"), F.lit(self.source_id).alias("source_id"), title.alias("title"), text.alias("content"), key.alias("file_path"), metadata.alias("metadata"), mark.alias("last_modified"), F.sha2(text, 256).alias("content_hash"))


class Incremental:
    """Reads only what is newer than the last read. The state at ``root`` is the documents of the highest mark, and of none, with their hashes: a row
    that comes later with the same mark is not lost, one that was read is not read twice.

    ``pending`` gives what is new, written to the checkpoint folder, for a database may change while it is used; ``done`` remembers it
    as read. What breaks off between the two is given again.
    """

    def __init__(self, spark: SparkSession, source: SqlSource, root: str):
        if not source.mark_column:
            raise ValueError("an incremental read needs a mark_column")
        self.spark, self.source, self.store = spark, source, Segments(spark, root, {"seen": SEEN}, fanout=4)

    def mark(self) -> str | None:
        """The highest mark that was read, as text."""
        seen = self.store.live("seen").where("mark is not null")
        return seen.select("mark").limit(1).collect()[0][0] if seen.head(1) else None

    def pending(self) -> DataFrame:
        rows = self.source.documents(self.source.rows(self.spark, self.mark()))
        seen = self.store.live("seen").select(F.col("doc_id").alias("id"), F.col("hash").alias("content_hash"), F.col("mark").alias("last_modified"))
        same = (rows["id"] == seen["id"]) & (rows["content_hash"] == seen["content_hash"]) & rows["last_modified"].eqNullSafe(seen["last_modified"])
        return cut(rows.join(seen, same, "left_anti"))

    def done(self, read: DataFrame) -> bool:
        """Remembers ``read`` (of ``pending``); nothing changes where it has no rows."""
        kind = self.source.rows(self.spark).schema[self.source.mark_column].dataType
        top = read.agg(F.max(F.col("last_modified").cast(kind)).cast("string")).first()[0]
        if not read.head(1):
            return False
        before = self.store.live("seen")
        last = self.mark()
        fresh = read.select(F.col("id").alias("doc_id"), F.col("last_modified").alias("mark"), F.col("content_hash").alias("hash"))
        stays = fresh.where(F.col("mark").isNull() | (F.col("mark") == F.lit(top)))
        # a new highest mark replaces what was kept of the last one
        old = before.where(F.col("mark").isNotNull()).select("doc_id") if top is not None and top != last else before.limit(0).select("doc_id")
        return self.store.commit({"seen": stays.dropDuplicates(["doc_id", "hash"])}, fresh.select("doc_id").union(old))
