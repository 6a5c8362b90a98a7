"""Streams over folders that grow: resumable document stages, exclusive job consumption, rate limits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_stage(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame], fmt: str = "parquet"
) -> StreamingQuery:
    """Take what is new in source through a stage and append it to target, then stop.

    The checkpoint remembers what was read, so a stage that ran half way goes on where it
    stopped and never takes a file twice; the Parquet sink's log makes appends atomic.
    """
    new = spark.readStream.schema(schema).format(fmt).load(source)
    return stage(new).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def run_batches(
    spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], fmt: str = "parquet"
) -> StreamingQuery:
    """Hand what is new in source to a function in micro-batches; a batch id that comes again must have the same effect."""
    new = spark.readStream.schema(schema).format(fmt).load(source)
    return new.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_state(spark: SparkSession) -> None:
    """Streams started from here on keep their state in RocksDB, as stateful processors ask; running and restarted ones keep what they have."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Limiter(StatefulProcessor):
    """One key's window as state: when it opened and how many hits it has had. An event-time timer at its end removes it."""

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.bucket = handle, handle.getValueState("bucket", "opened long, hits long")

    def _ends(self, opened: int) -> int:
        return (opened + self.window) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # 16 bytes a hit: what the source hands out at once bounds a key's hits in a batch
        frames = [(f["micros"].to_numpy(np.int64), f["hit_id"].to_numpy(np.int64)) for f in rows]
        micros, ids = (np.concatenate(c) for c in zip(*frames))
        order = np.lexsort((ids, micros))
        micros, ids = micros[order], ids[order]
        had = self.bucket.get() if self.bucket.exists() else None
        opened, hits = had if had else (int(micros[0]), 0)
        at, count, began = 0, np.empty(len(micros), np.int64), np.empty(len(micros), np.int64)
        while True:  # one step a window
            end = int(np.searchsorted(micros, opened + self.window, "right"))
            count[at:end], began[at:end] = np.arange(hits + 1, hits + 1 + end - at), opened
            hits, at = hits + end - at, end
            if at == len(micros):
                break
            opened, hits = int(micros[at]), 0
        if had is None or had[0] != opened:
            if had is not None:
                self.handle.deleteTimer(self._ends(had[0]))
            self.handle.registerTimer(self._ends(opened))
        self.bucket.update((opened, hits))
        allowed = count <= self.limit
        wait = np.where(allowed, 0, np.maximum(1, -(-(self.window - (micros - began)) // 1_000_000)))
        yield pd.DataFrame({"key": key[0], "hit_id": ids, "allowed": allowed, "remaining": np.maximum(self.limit - count, 0).astype(np.int32), "retry_after_seconds": wait.astype(np.int32)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        yield from ()


def rate_limit_stream(hits: DataFrame, limit: int, window_seconds: int, key: str = "key", at: str = "at", idle: str = "24 hours") -> DataFrame:
    """A stream of (key, hit_id, at) with allowed, remaining and retry_after_seconds.

    State is one opening time and one count for each key; it ends with its window, by an
    event-time timer, so keys that fall silent cost nothing. Hits later than ``idle`` are
    dropped, as any late row is; so are hits without a time or an id. Hits of a null key are one key's. Hits of a batch are taken
    in the order of their times, those of a later batch after them.
    """
    keep_state(hits.sparkSession)
    rows = hits.withWatermark(at, idle).select(F.col(key).cast("string").alias("key"), F.col("hit_id").cast("long"), F.unix_micros(at).alias("micros"), at).dropna(subset=["hit_id", "micros"])
    return rows.groupBy("key").transformWithStateInPandas(
        Limiter(limit, window_seconds), "key string, hit_id long, allowed boolean, remaining int, retry_after_seconds int", "append", "eventTime"
    )


class Versions(StatefulProcessor):
    """What was last made of one document as state: the hash of its content and a version."""

    def __init__(self, cut: Callable[[str], list[dict]], columns: list[str], ttl_ms: int | None):
        self.cut, self.columns, self.ttl = cut, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, version int", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # rows, not frames: most documents have one row, for which a frame costs more than all else
        newest = max((r["landed"], r["content"] or "") for r in rows)[1]
        content = hashlib.sha256(newest.encode()).hexdigest()
        had = self.last.get() if self.last.exists() else (None, 0)
        if had[0] == content:
            return
        parts = self.cut(newest)
        if not parts:  # stays as it was, and is taken again when it comes again
            return
        self.last.update((content, had[1] + 1))
        made = Row("document", "version", *self.columns)
        for part in parts:
            yield made(key[0], had[1] + 1, *map(part.get, self.columns))


def run_versions(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, cut: Callable[[str], list[dict]], parts: str,
    key: str = "doc_id", text: str = "text", at: str = "at", forget_after: float | None = None, fmt: str = "parquet", **constants: Column,
) -> StreamingQuery:
    """Cut the new and changed documents of source into parts and append these to target, then stop.

    State is a hash and a version for each document. A document that comes again as it was
    makes nothing, a changed one makes parts of the next version (see ``current``), one of
    which ``cut`` makes no parts stays pending, with what it had, until it comes again. Of
    several rows of a document in a batch the last by (at, text) counts; a null text is
    empty, a null ``at`` comes first. With ``forget_after`` seconds the state of a document
    that has not changed for so long is dropped, and it starts anew at version 1. ``parts``
    is the schema of what ``cut`` gives, whose names are others than the key's and version;
    constants are further columns of this run. Rows without a key make nothing.
    """
    keep_state(spark)
    new = spark.readStream.schema(schema).format(fmt).load(source)
    # names that begin with letters: rows reach the processor as named tuples
    rows = new.where(F.col(key).isNotNull()).select(
        F.col(key).alias("document"), F.col(text).alias("content"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**63))).alias("landed")
    )
    made = StructType.fromDDL(parts)
    out = StructType([StructField("document", rows.schema["document"].dataType), StructField("version", IntegerType()), *made.fields])
    work = Versions(cut, made.names, None if forget_after is None else round(forget_after * 1000))
    found = rows.groupBy("document").transformWithState(work, out, "append", "none" if forget_after is None else "processingTime")
    named = found.toDF(key, "version", *made.names).withColumns(constants)
    writer = named.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if forget_after is None:
        return writer.start(target)
    empty = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, "false")  # by processing time another batch is always due, and the run would never end
    try:
        return writer.start(target)
    finally:
        spark.conf.set(EMPTY_BATCHES, empty)


def current(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of what ``run_versions`` has appended, each document's parts of its last version."""
    last = parts.groupBy(key).agg(F.max("version").alias("version"))
    return parts.join(last, [key, "version"], "left_semi")


def drain_jobs_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, drain: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Drain each arriving file of jobs once: no other consumer of the checkpoint sees it again."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        drain(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return run_batches(spark, source, schema, checkpoint, handle)
