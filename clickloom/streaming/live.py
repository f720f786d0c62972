"""Structured Streaming versions of the live parts: upload intake (A4), recording status (C12), debounce as session
windows (C8/C9) and the screenshot throttle (C10), the last two of state per recording.

Every query checkpoints to a folder the caller passes (on a cluster: under the shared ``spark.checkpoint.dir``) and
writes each micro-batch through ``foreachBatch`` to a folder of its own, so nothing is collected on the driver, a
restarted query resumes from its checkpoint, and a batch that runs again replaces what its first run wrote.

State per recording lives in the RocksDB store and leaves it by event-time timers: nothing is kept of a recording
that the watermark has passed by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clickloom import model
from clickloom.session import listing_by_cores

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed: what Spark's reader of whole files gives.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: Rows of a result frame.
FRAME = 100_000


def write_batch(path: str):
    """A sink for ``foreachBatch``: batch n is the folder ``batch_id=n``, whole or replaced."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def run_available(stream_df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now, then stop (``trigger(availableNow)``)."""
    with listing_by_cores(stream_df.sparkSession):
        q = (stream_df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .foreachBatch(write_batch(sink)).trigger(availableNow=True).start())
        q.awaitTermination()


def intake(spark: SparkSession, landing: str, path: str = model.UPLOAD_PATH,
           origin: str = model.ALLOWED_ORIGIN_PREFIXES[0], most: int = model.MAX_BODY_BYTES) -> DataFrame:
    """A4: each file landing in ``landing`` is one upload body; admission (A5) runs per micro-batch.  Files above
    ``most`` bytes are answered by their length alone: the length is tested by the reader, before a file is opened,
    and their rows come from a scan without content.  Files of no bytes at all give no row: Spark's readers skip them.
    A batch's splits, of a few small files each, go to four tasks a core."""
    from clickloom.sources.payloads import admission
    tasks = 4 * spark.sparkContext.defaultParallelism

    def files():
        with listing_by_cores(spark):
            return spark.readStream.schema(BINARY_FILE).format("binaryFile").option("maxFilesPerTrigger", 10000).load(landing)

    def request(rows: DataFrame, body: Column) -> DataFrame:
        return rows.coalesce(tasks).select(F.col("path").alias("file"), body.cast("string").alias("body"), F.lit(path).alias("path"),
                           F.lit(origin).alias("origin"), F.col("length").alias("content_length"))

    return admission(request(files().filter(F.col("length") <= most), F.col("content"))
                     .unionByName(request(files().filter(F.col("length") > most), F.lit(None))), most)


def _per_recording(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, watermark: str) -> DataFrame:
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return (events.withWatermark("ts", watermark).groupBy(*keys)
            .transformWithStateInPandas(processor, schema, "Append", "EventTime"))


def _typed(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


class _Status(StatefulProcessor):
    """State: events counted, the time of the last one, the order of the stop (null: none)."""

    def __init__(self, keys: list[str], idle_ms: int):
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "n long, last_ms long, stop long")

    def row(self, key, n: int, recording: bool, last_ms: int) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "n_events": [n], "recording": [recording], "last_ms": [last_ms]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last, stop = self.state.get() if self.state.exists() else (0, 0, None)
        if stop is not None:  # what comes after the stop isn't recorded
            return
        stopped = False
        orders = []
        for frame in rows:
            halt = frame["is_stop"].to_numpy(bool)
            order = frame["ord"].to_numpy(np.int64)
            orders.append(order[~halt])
            last = max(last, int(frame["ts_ms"].max()))
            if halt.any():
                stop = int(order[halt].min()) if not stopped else min(stop, int(order[halt].min()))
                stopped = True
        n += sum(int((o < stop).sum()) if stopped else len(o) for o in orders)
        self.state.update((n, last, stop))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield self.row(key, n, not stopped, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last, stop = self.state.get()
        self.state.clear()
        if stop is None:
            yield self.row(key, n, False, last)

    def close(self) -> None:
        pass


def session_status(events: DataFrame, stop: Column | None = None, idle_ms: int = 3_600_000, keys="rec_id", watermark: str = "10 minutes") -> DataFrame:
    """``keys, n_events, recording, last_ms`` whenever a recording changes: how many events it has, and whether it
    is live.  The first event for which ``stop`` holds ends it and isn't counted, nor is what has a later ``ord``;
    so does silence for ``idle_ms`` by the watermark, after which nothing is kept of it.  Events have ``ord, ts_ms``;
    late ones are dropped."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    slim = events.select(*keys_l, "ord", "ts_ms", F.coalesce(F.lit(False) if stop is None else stop, F.lit(False)).alias("is_stop"),
                         F.timestamp_millis("ts_ms").alias("ts"))
    return _per_recording(slim, keys_l, _Status(keys_l, idle_ms), _typed(events, keys_l) + ", n_events bigint, recording boolean, last_ms bigint", watermark)


def debounce_sessions(events: DataFrame, quiet_ms: int, element: list[str], keys="rec_id",
                      watermark: str = "10 minutes") -> DataFrame:
    """C8/C9 streaming: a session window with gap ``quiet_ms`` per element;
    the session end is the emission time, the last event its value."""
    keys_l = ([keys] if isinstance(keys, str) else list(keys)) + list(element)
    w = F.session_window("ts", f"{quiet_ms} milliseconds")
    return (events.withWatermark("ts", watermark).groupBy(*keys_l, w)
            .agg(F.max("ord").alias("ord"), F.max_by("ts_ms", "ord").alias("last_ts_ms"))
            .select(*keys_l, "ord", (F.col("last_ts_ms") + F.lit(quiet_ms)).alias("emit_ts_ms"),
                    F.col("session_window.start").alias("session_start")))


class _Throttle(StatefulProcessor):
    """State: the time of the last event kept."""

    def __init__(self, keys: list[str], gap: int):
        self.keys, self.gap = keys, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "ts_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else 0
        before = last
        # two numbers a row are held, to bring a micro-batch's rows into order
        held = [(f["ord"].to_numpy(np.int64), f["ts_ms"].to_numpy(np.int64)) for f in rows]
        ords, times = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(ords, kind="stable")
        ords, times = ords[order], times[order]
        kept = np.zeros(len(ords), bool)
        i = 0
        while i < len(times):  # from one kept event to the next
            late = np.flatnonzero(times[i:i + FRAME] >= last + self.gap)
            if len(late):
                i += int(late[0])
                kept[i], last = True, int(times[i])
                i += 1
            else:
                i += FRAME
        if last != before:
            self.state.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # once the watermark is there, every event that can still come is kept with or without this state
            self.handle.registerTimer(last + self.gap)
        for at in range(0, len(ords), FRAME):
            part = slice(at, at + FRAME)
            yield pd.DataFrame({**{k: [v] * len(ords[part]) for k, v in zip(self.keys, key)}, "ord": ords[part], "kept": kept[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_state(events: DataFrame, min_gap_ms: int, keys="rec_id", watermark: str = "10 minutes") -> DataFrame:
    """C10 streaming: ``keys, ord, kept`` by the leading-edge throttle, with the time of the last event kept as state per
    recording.  Events have ``ord, ts_ms``; within a micro-batch they are taken in the order of ``ord``, late ones are
    dropped.  The state of a recording goes when the watermark is ``min_gap_ms`` past its last kept event, which
    changes no answer."""
    keys_l = [keys] if isinstance(keys, str) else list(keys)
    slim = events.select(*keys_l, "ord", "ts_ms", F.timestamp_millis("ts_ms").alias("ts"))
    return _per_recording(slim, keys_l, _Throttle(keys_l, min_gap_ms), _typed(events, keys_l) + ", ord bigint, kept boolean", watermark)
