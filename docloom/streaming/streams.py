"""Structured Streaming: metrics over a running log, debounced watching, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators import cdc

INTERVALS = {"15m": "15 minutes", "1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days"}


def daily_activity(log: DataFrame, late: str = "1 day", id_col: str = "id") -> DataFrame:
    """(day, total, rag) of a log stream; repeated ids count once, entries later than ``late`` not at all."""
    seen = log.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_col])
    out = seen.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("total"), F.count_if(F.col("intent").isin("question", "clarification")).alias("rag"))
    return out.select(F.to_date("window.start").alias("day"), "total", "rag")


def signature(changes: DataFrame) -> DataFrame:
    """One row: the state of a set of changes (type, path) as one short text, however they come; empty without changes.

    The number of changes and the sums of two parts of each one's hash, added up before anything is shuffled.
    """
    h = F.sha2(F.concat_ws(":", "change_type", "path"), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    n = F.count("*")
    return changes.agg(F.when(n > 0, F.concat_ws("-", n.cast("string"), part(1), part(16))).otherwise("").alias("signature"))


@dataclass
class Debounce:
    """Fires once a signature has stayed for ``delay`` seconds (5 at least); a new one starts the wait again, none ends it."""

    delay: float = 30.0
    pending: str = ""
    deadline: float | None = None

    def observe(self, sign: str, now: float) -> str:
        """idle, waiting or fire."""
        if not sign:
            self.pending, self.deadline = "", None
            return "idle"
        if sign != self.pending or self.deadline is None:
            self.pending, self.deadline = sign, now + max(self.delay, 5.0)
            return "waiting"
        if now < self.deadline:
            return "waiting"
        self.pending, self.deadline = "", None
        return "fire"


class DebounceProcessor(StatefulProcessor):
    """Debounce for each source of a stream (source, signature, at): a row out for every signature that stayed."""

    def __init__(self, delay: float = 30.0):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("debounce", "pending string, deadline double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else ("", None)
        d = Debounce(self.delay, held[0] or "", held[1])
        fired = []
        for r in pd.concat(list(rows)).sort_values("at").itertuples():
            if d.observe(r.signature or "", float(r.at)) == "fire":
                fired.append((key[0], r.signature, float(r.at)))
        self.state.update((d.pending, d.deadline))
        yield pd.DataFrame(fired, columns=["source", "signature", "at"])

    def close(self) -> None:
        pass


def debounced(watch: DataFrame, delay: float = 30.0) -> DataFrame:
    """The settled signatures of a stream (source, signature, at); needs the RocksDB state store."""
    return watch.groupBy("source").transformWithStateInPandas(DebounceProcessor(delay), "source string, signature string, at double", "Append", "none")


def incremental(read_known: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch is a listing (id, hash); its changes against what is known go to ``apply``.

    Nothing is removed by a batch: a stream of files never lists all of them at once.
    """

    def run(batch: DataFrame, number: int) -> None:
        found = cdc.changes(batch.select("id", "hash"), read_known().select("id", "hash")).where("change_type <> 'removed'")
        apply(found, number)

    return run


def eta_seconds(done_seconds: list[float], remaining: int) -> float:
    """Remaining documents at the mean time of those done; 0 before the first."""
    return remaining * sum(done_seconds) / len(done_seconds) if done_seconds else 0.0


def due(sources: DataFrame, now: str) -> DataFrame:
    """The sources (source, interval, last_run) whose interval has passed at ``now``, or that never ran; an unknown interval is never due."""
    length = F.lit(None).cast("interval day to second")
    for name, text in INTERVALS.items():
        length = F.when(F.col("interval") == name, F.expr(f"INTERVAL '{text.split()[0]}' {text.split()[1].rstrip('s').upper()}").cast("interval day to second")).otherwise(length)
    at = F.lit(now).cast("timestamp_ntz")
    return sources.where(length.isNotNull() & (F.col("last_run").isNull() | (F.col("last_run").cast("timestamp_ntz") + length <= at)))


def scheduled(stream: DataFrame, interval: str, run: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts ``stream`` with ``run`` on each micro-batch every ``interval`` (a name of INTERVALS); a restart goes on from ``checkpoint``."""
    return stream.writeStream.foreachBatch(run).trigger(processingTime=INTERVALS[interval]).option("checkpointLocation", checkpoint).start()


class Progress(StreamingQueryListener):
    """Tells ``publish`` (event, data) of queries that start, of every batch with its rows and what is left of ``total``, and of their end."""

    def __init__(self, publish: Callable[[str, dict], None], total: int = 0):
        self.publish, self.total, self.done, self.seconds = publish, total, 0, []

    def onQueryStarted(self, event) -> None:
        self.publish("started", {"id": str(event.id), "total": self.total})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.done += p.numInputRows
        if p.numInputRows:
            self.seconds.append(p.batchDuration / 1000 / p.numInputRows)
        left = max(self.total - self.done, 0)
        self.publish("progress", {"id": str(p.id), "done": self.done, "eta_seconds": eta_seconds(self.seconds, left), "coverage_percent": round(100 * min(self.done / self.total, 1), 2) if self.total else 0.0})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.publish("failed" if event.exception else "completed", {"id": str(event.id), "error": event.exception})
