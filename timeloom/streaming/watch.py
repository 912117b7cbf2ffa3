"""Streams of arriving files, jobs and cues."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import cues as C
from ..operators import quality as Q
from ..operators.jobs import ignored, is_supported
from ..sources.folders import files_of, opened
from ..sources.recognition import explode_raw_chunks


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = options["path"].split(",")
        self.recurse, self.every = options.get("recursive", "false") == "true", float(options.get("pollseconds", 5.0))
        self.last = 0

    def initialOffset(self) -> dict:
        return {"polled_at": 0}

    def latestOffset(self) -> dict:
        """The time of a poll, in microseconds: a new one once ``pollSeconds`` have passed since the last."""
        now = time.time_ns() // 1000
        if now - self.last >= self.every * 1e6:
            self.last = now
        return {"polled_at": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(root) for root in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """What the folder holds when the task runs; a batch that is run again observes it again."""
        system, path, prefix = opened(partition.value)
        now = datetime.datetime.now(datetime.UTC)
        for file in files_of(system, path, self.recurse):
            yield prefix + file.path, file.size, file.mtime.astimezone(datetime.UTC), now


class FolderObservations(DataSource):
    """Stream of what folders hold at each poll: every file each time, so that later polls show whether it still grows.
    Options: path (several folders parted by commas, one task each), recursive, pollSeconds."""

    @classmethod
    def name(cls) -> str:
        return "folder_observations"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp, observed_at timestamp"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))


def observe_folders(spark: SparkSession, roots: list[str], poll_s: float = 5.0, recurse: bool = False) -> DataFrame:
    """Stream of observations (path, size, mtime, observed_at) of supported media files, each file at every poll."""
    spark.dataSource.register(FolderObservations)
    options = {"path": ",".join(roots), "recursive": str(recurse).lower(), "pollSeconds": str(poll_s)}
    seen = spark.readStream.format("folder_observations").options(**options).load()
    return seen.where(is_supported(F.col("path")) & ~ignored(F.col("path")))


def new_media(spark: SparkSession, roots: list[str], poll_s: float = 5.0, checks: int = 3, min_age_s: float = 10.0, recurse: bool = False) -> DataFrame:
    """Stream of supported media files as they arrive whole: each path once, when ``checks`` polls after one found it
    unchanged, not empty and old enough."""
    return stable_file_stream(observe_folders(spark, roots, poll_s, recurse), checks, min_age_s)


def stable_files(observations: DataFrame, checks: int = 3, min_age_s: float = 10.0) -> DataFrame:
    """Files of a table of observations (path, size, mtime, observed_at) that ``checks`` observations after one found
    unchanged, not empty and old enough: the first such observation of each."""
    order = Window.partitionBy("path").orderBy("observed_at")
    span = order.rowsBetween(-checks, 0)
    rows = observations.where(is_supported(F.col("path")) & ~ignored(F.col("path")))
    calm = (F.min("size").over(span) == F.max("size").over(span)) & (F.count("*").over(span) == checks + 1) & (F.col("size") > 0)
    old = F.unix_micros("observed_at") - F.unix_micros("mtime") >= int(min_age_s * 1e6)
    found = rows.withColumn("stable", calm & old).where("stable")
    return found.groupBy("path").agg(F.min_by(F.struct("size", "mtime", "observed_at"), "observed_at").alias("s")).select("path", "s.*")


def stable_file_stream(observations: DataFrame, checks: int = 3, min_age_s: float = 10.0, forget_after: str = "1 hour") -> DataFrame:
    """The same over a stream of observations; a path is reported once, and forgotten after a silence."""
    rows = observations.where(is_supported(F.col("path")) & ~ignored(F.col("path")))
    minutes = int(pd.Timedelta(forget_after).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        size, calm, told = state.get if state.exists else (-1, 0, False)
        for rows in batches:
            for row in rows.sort_values("observed_at").itertuples():
                calm = calm + 1 if row.size_ == size and size > 0 else 0
                size = row.size_
                if not told and calm >= checks and (row.observed_at - row.mtime).total_seconds() >= min_age_s:
                    told = True
                    yield pd.DataFrame({"path": [key[0]], "size": [size], "observed_at": [row.observed_at]})
        state.update((size, calm, told))
        state.setTimeoutDuration(minutes)

    named = rows.select("path", F.col("size").alias("size_"), "mtime", "observed_at")
    return named.groupBy("path").applyInPandasWithState(step, "path string, size long, observed_at timestamp", "size long, calm int, told boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def attempt_counts(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Attempts of each name so far, and whether they are beyond the limit; for tables and streams (update mode)."""
    return attempts.groupBy("name").agg(F.count("*").alias("attempts")).withColumn("failed", F.col("attempts") > limit)


def latest_progress(events: DataFrame) -> DataFrame:
    """The newest event of each job, with its share done; for tables and streams (update mode)."""
    latest = events.groupBy("job_id").agg(F.max_by(F.struct("stage", "message", "current", "total", "elapsed_seconds", "updated_at"), "updated_at").alias("e")).select("job_id", "e.*")
    return latest.withColumn("percent", F.when(F.col("total") > 0, F.bround(100.0 * F.col("current") / F.col("total"), 1)))


def worker_health(beats: DataFrame, now, max_age_s: float = 120.0) -> DataFrame:
    """Workers by their newest beat (worker, updated_at, status, model_loaded, gpu_available, watcher_running): healthy
    or not, and why."""
    fields = ("updated_at", "status", "model_loaded", "gpu_available", "watcher_running")
    last = beats.groupBy("worker").agg(F.max_by(F.struct(*fields), "updated_at").alias("b")).select("worker", "b.*")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1e6
    reason = F.when(age > max_age_s, "stale")
    for flag in fields[2:]:
        reason = reason.when(~F.coalesce(F.col(flag), F.lit(False)), f"bad {flag}")
    return last.withColumn("age_s", age).withColumn("reason", reason.when(F.coalesce(F.col("status"), F.lit("")) != "ready", "bad status")).withColumn("healthy", F.col("reason").isNull())


def in_flight_once(paths: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each path of a stream (path, seen_at) once within ``delay``."""
    return paths.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["path"])


class HeldSegments(StatefulProcessor):
    """Holds the segments of a media until all of them are there, whatever batches bring them."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "segment_no int", "raw string")
        self.done = handle.getValueState("done", "done boolean", self.patience_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wanted = 0
        for part in rows:
            for number, total, raw in zip(part["segment_no"], part["segments"], part["raw"]):
                wanted = max(wanted, int(total))
                if not self.parts.containsKey((int(number),)):  # a segment that comes again counts as it came first
                    self.parts.updateValue((int(number),), (raw,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if self.done.exists():
            self.parts.clear()
        elif sum(1 for _ in self.parts.keys()) >= wanted:
            yield self._given(key, True)
            self.done.update((True,))
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._given(key, False)

    def _given(self, key, complete: bool) -> pd.DataFrame:
        found = sorted((number[0], raw[0]) for number, raw in self.parts.iterator())
        self.parts.clear()
        return pd.DataFrame({"media_id": [key[0]] * len(found), "segment_no": [n for n, _ in found], "raw": [r for _, r in found], "complete": complete})

    def close(self) -> None:
        pass


def whole_media(raw: DataFrame, patience_s: float = 3600.0) -> DataFrame:
    """Stream of the segments of media that are complete: media_id, segment_no, raw, complete.

    ``raw`` is a stream (media_id, segment_no, segments, raw), segments being how many the media has. Segments are held in
    state until that many different ones are there, and then given together, in one batch; a media that waits longer than
    ``patience_s`` for its next one is given as it is, with complete false. Once a media is given, segments that come again
    within that time are dropped. Needs the state store that transformWithState asks for, which is set for the session."""
    raw.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = raw.schema["media_id"].dataType.simpleString()
    named = raw.select("media_id", F.col("segment_no").cast("int").alias("segment_no"), F.col("segments").cast("int").alias("segments"), "raw")
    out = f"media_id {kind}, segment_no int, raw string, complete boolean"
    return named.groupBy("media_id").transformWithStateInPandas(HeldSegments(int(patience_s * 1000)), out, "Append", "processingTime")


def cue_stream(raw: DataFrame, sink: Callable[[DataFrame, DataFrame, DataFrame], None], checkpoint: str, patience_s: float = 3600.0, trigger: dict | None = None, **limits):
    """Start a query over a stream of raw results (media_id, segment_no, segments, raw): of media that are complete,
    whichever batches brought their segments, chunks are repaired and grouped, and ``sink`` gets (cues, issues, given_up),
    the last with the segments of media that were not completed in time. ``trigger`` says how the query runs, every ten
    seconds if not given; one that ends by itself has to be {"once": True}, as waiting media keep others from ending."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            cues = C.group_cues(C.repair_chunks(C.concat_segments(explode_raw_chunks(batch.where("complete")).where("valid"))), **limits)
            sink(cues, Q.quality_issues(cues), batch.where("not complete").drop("complete"))
        finally:
            batch.unpersist()

    held = whole_media(raw, patience_s)
    return held.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
