"""File events as streams: debounce, rename correlation, micro-batch application.

Lateness is bounded by a watermark on the event time; the batch twins are in ``operators.maintenance``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quern.sources.snapshots import SnapshotTable


def debounce(events: DataFrame, keys: list[str], quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """The last event of each burst of a key, sent once its session has been quiet and the watermark has passed."""
    marked = events.withWatermark("ts", late)
    rest = [c for c in events.columns if c not in (*keys, "ts")]
    return (
        marked.groupBy(*keys, F.session_window("ts", quiet))
        .agg(F.max(F.struct("ts", *rest)).alias("_l"), F.count(F.lit(1)).alias("n_events"))
        .select(*keys, "_l.*", "n_events")
    )


class RenameProcessor(StatefulProcessor):
    """Holds each unlink of a key until an add follows in the window or its timer runs out; a key keeps a queue of unlinks."""

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "path string, size long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = list(self.pending.get())
        out = []
        events = sorted(((int(r.at), r.kind, r.path, r.size) for df in rows for r in df.itertuples()), key=lambda e: (e[0], e[1] != "unlink"))
        for at, kind, path, size in events:
            if kind == "unlink":
                held.append((path, None if pd.isna(size) else int(size), at))
                self.handle.registerTimer(at + self.window_ms)
            else:
                fits = [h for h in held if 0 <= at - h[2] <= self.window_ms]
                if fits:
                    old = fits[-1]
                    held.remove(old)
                    both = old[1] is not None and not pd.isna(size)
                    out.append(("renamed", path, old[0], (0.9 if old[1] == size else 0.7) if both else 0.9 if old[1] is not None else 0.7))
                else:
                    out.append(("added", path, None, None))
        self._store(held)
        yield pd.DataFrame(out, columns=["change", "path", "old_path", "confidence"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.pending.get())
        gone = [h for h in held if h[2] + self.window_ms <= now]
        self._store([h for h in held if h[2] + self.window_ms > now])
        yield pd.DataFrame([("deleted", h[0], None, None) for h in gone], columns=["change", "path", "old_path", "confidence"])

    def _store(self, held: list) -> None:
        if held:
            self.pending.put([tuple(h) for h in held])
        else:
            self.pending.clear()

    def close(self) -> None:
        pass


def correlate_renames(events: DataFrame, window_ms: int = 500, late: str = "10 seconds") -> DataFrame:
    """(change, path, old_path, confidence) from unlink and add events (folder, path, kind, size, ts), per folder and base name.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = events.withWatermark("ts", late).select("folder", F.element_at(F.split("path", r"[/\\]"), -1).alias("base"), "path", "kind", F.col("size").cast("long"), F.unix_millis("ts").alias("at"), "ts")
    return keyed.groupBy("folder", "base").transformWithStateInPandas(
        RenameProcessor(window_ms), "change string, path string, old_path string, confidence double", "Append", "EventTime"
    )


def apply_stream(changes: DataFrame, table: SnapshotTable, chunks_of: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Apply changes (repository, path, old_path, change) to a chunk table batch by batch; a batch replayed gives the same table.

    Only the buckets of the batch's files are read and written. ``chunks_of`` makes the new chunks of a batch's added, modified and renamed files. Back-pressure is the
    source's (``maxFilesPerTrigger`` and the like); the trigger interval is the longest wait.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        table.apply(batch, chunks_of(batch.where(F.col("change") != "deleted")))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
