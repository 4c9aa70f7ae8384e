"""Joins, de-duplication and windows of streams with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vidlake.operators.metrics import STALE_SECONDS
from vidlake.streaming.channels import use_rocksdb


def sync_stream(a: DataFrame, b: DataFrame, timeout: str = "40 milliseconds") -> DataFrame:
    """Frames of either branch (channel_index, frame_index, frame_ts, targets ARRAY), joined where both come, alone once the watermark has passed them.

    Rows later than the watermark are discarded. Each branch's own watermark is the timeout.
    """
    x = a.withWatermark("frame_ts", timeout)
    y = b.select(F.col("channel_index").alias("c"), F.col("frame_index").alias("f"), F.col("frame_ts").alias("ts"), F.col("targets").alias("more")).withWatermark("ts", timeout)
    both = x.join(y, (F.col("channel_index") == F.col("c")) & (F.col("frame_index") == F.col("f")) & (F.col("frame_ts") == F.col("ts")), "full")
    none = F.array().cast(dict(a.dtypes)["targets"])
    return both.select(
        F.coalesce("channel_index", "c").alias("channel_index"), F.coalesce("frame_index", "f").alias("frame_index"),
        F.concat(F.coalesce("targets", none), F.coalesce("more", none)).alias("targets"), (F.col("c").isNull() | F.col("channel_index").isNull()).alias("alone"),
    )


def first_per_track_stream(targets: DataFrame, within: str = "10 minutes", min_tracked: int = 25, min_width: int = 50, min_height: int = 50, only_for_tracked: bool = False) -> DataFrame:
    """Each track's first large enough target while the watermark remembers it; frame_ts is the event time.

    only_for_tracked: only targets that have been followed for min_tracked frames
    (history); else targets without a track pass too, each by itself.
    """
    sized = targets.where((F.col("width") >= min_width) & (F.col("height") >= min_height))
    tracked = sized.where(F.col("track_id") >= 0)
    if only_for_tracked:
        tracked = tracked.where(F.col("history") >= min_tracked)
    once = tracked.withWatermark("frame_ts", within).dropDuplicatesWithinWatermark(["channel_index", "track_id"])
    return once if only_for_tracked else once.unionByName(sized.where("track_id < 0").withWatermark("frame_ts", within))


def dedupe_controls_stream(controls: DataFrame, within: str = "1 minute") -> DataFrame:
    """Controls whose uid the channel has not had within the watermark: stronger than comparing neighbours."""
    return controls.withWatermark("create_time", within).dropDuplicatesWithinWatermark(["channel_index", "control_uid"])


def output_fps_stream(trace: DataFrame, epoch_ms: int = 500, late: str = "1 second") -> DataFrame:
    """Frames per second of each channel and grid cell, once the cell is over."""
    cell = F.window("in_time", f"{epoch_ms} milliseconds")
    return trace.withWatermark("in_time", late).groupBy("channel_index", cell.alias("w")).agg((F.count(F.lit(1)) * 1000 / epoch_ms).alias("fps")).select("channel_index", F.col("w.start").alias("epoch"), "fps")


class _Watch(StatefulProcessor):
    """One port of a node: its latest event, and a timer for when that is too long ago."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ms long, stale boolean")

    def _row(self, key: tuple, ms: int, stale: bool) -> pd.DataFrame:
        return pd.DataFrame([(*key, pd.Timestamp(ms, unit="ms"), stale)], columns=["node", "port", "at", "stale"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was, stale = self.latest.get() or (None, False)
        if was is not None:
            self.handle.deleteTimer(was + self.gap_ms)
        for at in sorted(int(ms) for part in rows for ms in part["ms"]):
            if was is not None and at <= was:
                continue
            # a port that is active again before its timer has run was stale all the same
            if was is not None and not stale and at - was >= self.gap_ms:
                yield self._row(key, was + self.gap_ms, True)
                stale = True
            if stale:
                yield self._row(key, at, False)
            was, stale = at, False
        self.latest.update((was, stale))
        if not stale:
            self.handle.registerTimer(was + self.gap_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        was, stale = self.latest.get()
        if not stale and was + self.gap_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.update((was, True))
            yield self._row(key, was + self.gap_ms, True)

    def close(self) -> None:
        pass


def stale_ports_stream(trace: DataFrame, seconds: float = STALE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """(node, port, at, stale): when each port of trace (node, port, in_time) became stale, and when it was active again.

    A port is stale once the watermark is so many seconds past its latest event, though
    it sends nothing itself; events of other ports move the watermark.
    """
    use_rocksdb(trace.sparkSession)
    rows = trace.select("node", "port", "in_time").withWatermark("in_time", late).withColumn("ms", F.unix_millis("in_time"))
    return rows.groupBy("node", "port").transformWithStateInPandas(_Watch(round(seconds * 1000)), "node string, port string, at timestamp, stale boolean", "append", "eventTime")
