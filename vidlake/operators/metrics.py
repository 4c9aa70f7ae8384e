"""Stream metrics from the trace of nodes (channel_index, frame_index, node, port, in_time, out_time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.operators.ordered import previous


def _micros(ts: Column) -> Column:
    """Microseconds since the epoch, of either kind of timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _cell(ts: Column, ms: int) -> Column:
    return F.floor(_micros(ts) / (ms * 1000)) * ms


def _ms(a: Column, b: Column) -> Column:
    return (_micros(b) - _micros(a)) / 1000


def output_fps(trace: DataFrame, epoch_ms: int = 500) -> DataFrame:
    """(channel_index, epoch_ms, fps): frames per second in each cell of a fixed grid."""
    return trace.groupBy("channel_index", _cell(F.col("in_time"), epoch_ms).alias("epoch_ms")).agg((F.count(F.lit(1)) * 1000 / epoch_ms).alias("fps"))


def latency(trace: DataFrame, epoch_ms: int = 3_600_000) -> DataFrame:
    """Average, exact 95th percentile and greatest milliseconds from creation to sink, per channel and cell.

    The exact percentile keeps the distinct values of a group; latency_sketch does not.
    """
    ms = _ms(F.col("in_time"), F.col("out_time"))
    return trace.groupBy("channel_index", _cell(F.col("in_time"), epoch_ms).alias("epoch_ms")).agg(F.round(F.avg(ms), 6).alias("avg_ms"), F.round(F.percentile(ms, F.lit(0.95)), 6).alias("p95_ms"), F.max(ms).alias("max_ms"))


#: Relative error of the percentiles of latency_sketch, and the milliseconds below which values count as 0.
SKETCH_ERROR, SKETCH_LEAST = 0.01, 1e-3


def latency_sketch(trace: DataFrame, epoch_ms: int = 3_600_000, error: float = SKETCH_ERROR) -> DataFrame:
    """(channel_index, epoch_ms, bin, n, total, max_ms): a histogram of latencies a cell, in bins of equal ratio.

    A value lies within `error` of the middle of its bin. Sketches of cells add up to
    that of a coarser cell (rolled_up), and a cell has as many rows as its latencies
    have orders of magnitude, some 230 each at one per cent, however many events it has.
    """
    ms = _ms(F.col("in_time"), F.col("out_time"))
    ratio = (1 + error) / (1 - error)
    number = F.when(F.col("ms") < SKETCH_LEAST, None).otherwise(F.ceil(F.log("ms") / F.log(F.lit(ratio)))).cast("int")
    rows = trace.select("channel_index", _cell(F.col("in_time"), epoch_ms).alias("epoch_ms"), ms.alias("ms")).withColumn("bin", number)
    return rows.groupBy("channel_index", "epoch_ms", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total"), F.max("ms").alias("max_ms"))


def rolled_up(sketch: DataFrame, epoch_ms: int) -> DataFrame:
    """Sketches of cells as those of the coarser cells they lie in."""
    coarse = sketch.withColumn("epoch_ms", (F.floor(F.col("epoch_ms") / epoch_ms) * epoch_ms).cast("long"))
    return coarse.groupBy("channel_index", "epoch_ms", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("max_ms").alias("max_ms"))


def sketch_latency(sketch: DataFrame, share: float = 0.95, error: float = SKETCH_ERROR) -> DataFrame:
    """(channel_index, epoch_ms, avg_ms, p95_ms, max_ms) of sketches; p95_ms is within `error` of the value at that share of the cell's events."""
    ratio = (1 + error) / (1 - error)
    so_far = Window.partitionBy("channel_index", "epoch_ms").orderBy(F.col("bin").asc_nulls_first())
    whole = Window.partitionBy("channel_index", "epoch_ms")
    placed = sketch.withColumns({"below": F.sum("n").over(so_far), "all": F.sum("n").over(whole)})
    reached = F.when(F.col("below") >= F.ceil(F.col("all") * share), F.coalesce(F.pow(F.lit(ratio), F.col("bin")) * (1 - error), F.lit(0.0)))
    p = F.min(reached)
    return placed.groupBy("channel_index", "epoch_ms").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("avg_ms"), p.alias("p95_ms"), F.max("max_ms").alias("max_ms"))


def stream_status(trace: DataFrame) -> DataFrame:
    """Per channel and node: the latest frame, its latency, its size where trace has width and height, how many frames, and frames per second from the first to the last."""
    size = [c for c in ("width", "height") if c in trace.columns]
    latest = F.max_by(F.struct("frame_index", _ms(F.col("in_time"), F.col("out_time")).alias("ms"), *size), F.struct("in_time", "event_id"))
    span = _ms(F.min("in_time"), F.max("in_time")) / 1000
    rows = trace.groupBy("channel_index", "node").agg(latest.alias("l"), F.count(F.lit(1)).alias("frames"), span.alias("s"))
    fps = F.when(F.col("s") > 0, F.round((F.col("frames") - 1) / F.col("s"), 6))
    return rows.select("channel_index", "node", F.col("l.frame_index").alias("frame_index"), F.col("l.ms").alias("latency_ms"), "frames", fps.alias("fps"), *[F.col(f"l.{c}").alias(c) for c in size])


def node_throughput(trace: DataFrame, epoch_ms: int = 3_600_000) -> DataFrame:
    """Events per node, port and cell."""
    return trace.groupBy("node", "port", _cell(F.col("in_time"), epoch_ms).alias("epoch_ms")).agg(F.count(F.lit(1)).alias("events"))


def queue_depth(trace: DataFrame, epoch_ms: int = 3_600_000) -> DataFrame:
    """Per node and cell: arrivals less departures so far. Cells are summed first, so the running sum is over cells."""
    change = F.sum(F.when(F.col("port") == "in", 1).otherwise(-1))
    cells = trace.groupBy("node", _cell(F.col("in_time"), epoch_ms).alias("epoch_ms")).agg(change.alias("change"))
    so_far = Window.partitionBy("node").orderBy("epoch_ms").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("node", "epoch_ms", F.sum("change").over(so_far).alias("depth"))


#: Seconds without an event after which a port's rate is void (fixed value).
STALE_SECONDS = 5


def stale_ports(trace: DataFrame, seconds: float = STALE_SECONDS) -> DataFrame:
    """(node, port, active_from, stale_from, active_again, events): the stretches in which a port was active, and from when on it was stale.

    An event keeps its port active for so many seconds; active_again is null where no
    event has come since. Sessions are summed before they are put in order, so only
    stretches are windowed.
    """
    gap = F.session_window("in_time", f"{round(seconds * 1000)} milliseconds")
    active = trace.groupBy("node", "port", gap.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    again = F.lead("w.start").over(Window.partitionBy("node", "port").orderBy("w.start"))
    return active.select("node", "port", F.col("w.start").alias("active_from"), F.col("w.end").alias("stale_from"), again.alias("active_again"), "events")


def hop_time(trace: DataFrame) -> DataFrame:
    """Per event: milliseconds in its node, and from the channel's event before."""
    before = F.lag("out_time").over(Window.partitionBy("channel_index", "node").orderBy("in_time", "event_id"))
    return trace.select("channel_index", "node", "event_id", _ms(F.col("in_time"), F.col("out_time")).alias("in_node_ms"), _ms(before, F.col("in_time")).alias("gap_ms"))


def threshold_alerts(series: DataFrame, keys: list[str], order: str, value: str, limit: float) -> DataFrame:
    """Rows at which value comes above limit; the next alert only after it was at or below."""
    above = F.col(value) > limit
    return previous(series, keys, [order], above, "_was").where(above & ~F.coalesce("_was", F.lit(False))).drop("_was")
