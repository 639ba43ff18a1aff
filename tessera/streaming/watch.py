"""Change events as a stream: debounced batches, delta application, request limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.text import LANGUAGES, searchable_text
from tessera.operators.access import SEARCHES, WINDOW_SECONDS

# Fixed value: the quiet time that closes a batch, in milliseconds.
QUIET_MS = 500


def relevant(events: DataFrame, index_folder: str = ".tessera") -> DataFrame:
    """File events that matter: no folders, nothing hidden or in the index folder, a known extension unless deleted."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | (p == index_folder))
    known = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*LANGUAGES)
    return events.where(~hidden & (known | (F.col("event") == "deleted")))


def debounce(events: DataFrame, by: str, quiet: str = f"{QUIET_MS} milliseconds", watermark: str | None = "10 seconds") -> DataFrame:
    """by, started, ended, paths: batches of events that a quiet time closes. Works on streams and tables.

    A batch holds the distinct paths of one key, as an array; a watermark bounds the state.
    """
    d = events.withWatermark("ts", watermark) if watermark and events.isStreaming else events
    g = d.groupBy(F.session_window("ts", quiet).alias("w"), by).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("events"))
    return g.select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths", "events")


def debounce_batch(events: DataFrame, by: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """by, started, last, events, batch: debounce by gaps and islands, without the arrays."""
    own = W.partitionBy(by).orderBy("ts", "event_id")
    gap = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(own).cast("timestamp")) >= quiet_ms * 1000, F.lit(True))
    d = events.withColumn("__new", gap).withColumn("batch", F.sum(F.col("__new").cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(by, "batch").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("events"))


def watch_folder(spark: SparkSession, root: str) -> DataFrame:
    """New files of a folder as a stream of path, ts, length and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)


def apply_stream(batches: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Starts a query that hands each batch of changes to `handle`; it restarts where it left off."""
    return batches.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{QUIET_MS} milliseconds"})).start()


def delta_handler(store, parse: Callable[[DataFrame], DataFrame], read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A handler that brings chunks, files and postings up to date with a batch of paths. Only the
    chunks of these paths are tokenized again.

    read gives the files (with text, file_hash, total_lines, total_bytes) of a table of paths
    that still exist; the others are deleted.
    """
    from tessera.operators import bm25
    from tessera.session import materialize

    def handle(batch: DataFrame, number: int) -> None:
        paths = batch.select(F.explode("paths").alias("file_path")).distinct()
        files = materialize(read(paths), "changed")
        fresh = materialize(parse(files), "fresh")
        gone = materialize(store.read("chunks").join(paths, "file_path", "left_semi").select("chunk_id"), "gone")
        text = fresh.select("chunk_id", searchable_text(F.col).alias("text"))
        lexical = bm25.update(store.lexical(), gone, text)
        store.write("chunks", store.read("chunks").join(paths, "file_path", "left_anti").unionByName(fresh.select(*store.read("chunks").columns)), by="file_path")
        counts = fresh.groupBy("file_path").agg(F.count("*").cast("int").alias("chunk_count"))
        rows = files.join(counts, "file_path", "left").select("file_path", "file_hash", "language", "total_lines", "total_bytes", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
        store.write("files", store.read("files").join(paths, "file_path", "left_anti").unionByName(rows.select(*store.read("files").columns)))
        store.save_lexical(lexical)

    return handle


def limit_stream(requests: DataFrame, limit: int = SEARCHES, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """client, request_id, ts, allowed for a stream of requests; the state of a client is the accepted times of one window."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times: list[int] = list(state.get[0]) if state.exists else []
        rows: list[Any] = []
        # the rows of one trigger and client, in order
        for b in [pd.concat(list(frames)).sort_values(["ts", "request_id"])]:
            for i, t in zip(b.request_id, b.ts):
                us = int(t.value // 1000)
                times = [x for x in times if us - x < seconds * 1_000_000]
                rows.append((key[0], i, t, len(times) < limit))
                if rows[-1][3]:
                    times.append(us)
        state.update((times,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame(rows, columns=["client", "request_id", "ts", "allowed"])

    types = dict(requests.dtypes)
    out = f"client {types['client']}, request_id {types['request_id']}, ts timestamp, allowed boolean"
    return requests.groupBy("client").applyInPandasWithState(step, out, "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
