"""Structured Streaming forms of the live operators.  Each equals its batch form over the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from graphloom.functions import text as X
from graphloom.model import WEIGHTS
from graphloom.operators.learn import adapt_runs, boost_runs
from graphloom.sources.files import commit, listed, read_text

#: The state store that timers need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def access_counts(reads: DataFrame, promote_at: int = 10) -> DataFrame:
    """(obj_id, n, promoted), update or complete mode; state is one row per object."""
    return reads.groupBy("obj_id").agg(F.count("*").alias("n")).withColumn("promoted", F.col("n") >= promote_at)


def pattern_windows(fixes: DataFrame, at: str = "ts", window: str = "14 days", slide: str = "1 day", threshold: int = 3, late: str = "1 day") -> DataFrame:
    """(entity_id, start, n): sliding windows with `threshold` fixes or more; state goes when the watermark passes a window."""
    w = fixes.withWatermark(at, late).groupBy(F.window(at, window, slide), "entity_id").agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= threshold).select("entity_id", F.col("window.start").alias("start"), "n")


def inactive(reads: DataFrame, at: str = "ts", gap: str = "30 days", late: str = "1 day") -> DataFrame:
    """(obj_id, last_access, n) of activity sessions that a gap has ended: candidates for demotion."""
    s = reads.withWatermark(at, late).groupBy(F.session_window(at, gap), "obj_id").agg(F.count("*").alias("n"), F.max(at).alias("last_access"))
    return s.select("obj_id", "last_access", "n")


def request_rate(requests: DataFrame, at: str = "ts", window: str = "60 seconds", slide: str = "1 second", most: int = 100) -> DataFrame:
    w = requests.withWatermark(at, window).groupBy(F.window(at, window, slide), "client").agg(F.count("*").alias("n"))
    return w.where(F.col("n") > most).select("client", F.col("window.start").alias("start"), "n")


def new_imports(rows: DataFrame, at: str = "ts", within: str = "30 days") -> DataFrame:
    """Rows whose content hash was not seen within the watermark."""
    return rows.withColumn("hash", X.content_hash(F.col("title"), F.col("content"))).withWatermark(at, within).dropDuplicatesWithinWatermark(["hash"])


def postings(rows: DataFrame) -> DataFrame:
    """(id, term, tf): index rows of new objects."""
    return rows.select("id", F.explode(X.tokens(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Work off all that is there and stop; `sink` gets each micro-batch and its number, by which it can be idempotent."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@dataclass(frozen=True)
class WeightLog:
    """Ranking weights kept by a stream of boosts: one small file a batch, renamed into place, so that a batch that comes again changes nothing."""

    spark: SparkSession
    path: str
    start: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def read(self) -> tuple[dict[str, float], int]:
        """(weights, number of the last batch), the start and -1 before the first one."""
        found = sorted(n for n in listed(self.spark, self.path) if n.startswith("b"))
        if not found:
            return dict(self.start), -1
        return json.loads(read_text(self.spark, f"{self.path}/{found[-1]}")), int(found[-1][1:])

    def sink(self, order: list[str]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that adapts the weights by a batch's boosts (boost, order columns); the tasks put them into runs."""

        def run(batch: DataFrame, number: int) -> None:
            weights, last = self.read()
            if number > last:
                commit(self.spark, self.path, f"b{number:012d}", json.dumps(adapt_runs(weights, boost_runs(batch.select("boost", *order), order))))

        return run


class _Tiers(StatefulProcessor):
    """Accesses of one object: waiting ones until the watermark has passed them, then in order; a timer wakes the object for the next of them or for its demotion."""

    def __init__(self, promote_at: int, inactive_ms: int) -> None:
        self.promote_at, self.inactive_ms = promote_at, inactive_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "n long, last long, reflex boolean")
        self.waiting = handle.getListState("waiting", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(ms),) for part in rows for ms in part["ms"]]
        self.waiting.appendList(new)
        yield self._advanced(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._advanced(key, timerValues.getCurrentWatermarkInMs())

    def _advanced(self, key, now: int) -> pd.DataFrame:
        n, last, reflex = self.state.get() if self.state.exists() else (0, 0, False)
        waiting = sorted(r[0] for r in self.waiting.get())
        ready, rest = [x for x in waiting if x <= now], [x for x in waiting if x > now]
        out = []
        for x in ready:
            if reflex and x - last > self.inactive_ms:
                out.append((last + self.inactive_ms, "demote"))
                reflex = False
            n, last = n + 1, x
            if n >= self.promote_at and not reflex:
                out.append((x, "promote"))
                reflex = True
        if reflex and now - last > self.inactive_ms:
            out.append((last + self.inactive_ms, "demote"))
            reflex = False
        self.state.update((n, last, reflex))
        if rest:
            self.waiting.put([(x,) for x in rest])
        else:
            self.waiting.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        wake = [*rest[:1], *([last + self.inactive_ms + 1] if reflex else [])]
        if wake:
            self.handle.registerTimer(max(min(wake), now + 1))
        plain = lambda values: pd.Series(values, dtype=object)  # noqa: E731  Spark takes strings in one piece
        return pd.DataFrame({"obj_id": plain([key[0]] * len(out)), "at": pd.to_datetime([x for x, _ in out], unit="ms"), "change": plain([c for _, c in out])})


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Queries that start within have the state store that timers need."""
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)


def tier_changes(reads: DataFrame, at: str = "ts", promote_at: int = 10, inactive: timedelta = timedelta(days=30), late: str = "1 day") -> DataFrame:
    """(obj_id, at, change) in append mode: `promote` at the access that is the promote_at-th or a later one of an object that is not reflex, `demote`
    once it was not accessed for `inactive`.  Objects that come back are promoted again, for their accesses are counted on.

    State is one row an object and its accesses within the watermark, in RocksDB (spark.sql.streaming.stateStore.providerClass must name it).
    Rows out of order within `late` change nothing: an access counts when the watermark has passed it.
    """
    rows = reads.withWatermark(at, late).select("obj_id", at, F.unix_millis(at).alias("ms"))
    return rows.groupBy("obj_id").transformWithStateInPandas(_Tiers(promote_at, int(inactive.total_seconds() * 1000)), "obj_id string, at timestamp, change string", "Append", "EventTime")
