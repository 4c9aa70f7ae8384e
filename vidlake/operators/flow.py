"""Splitting, merging, synchronising and pairing of channels and branches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.functions.geometry import project_point
from vidlake.operators.ordered import previous
from vidlake.operators.storage import written

FRAME = ["channel_index", "frame_index"]
#: What a second branch fills where it is empty, and what it adds to.
EMPTY, LISTS = ("history", "mask", "embedding"), ("secondary", "secondary_ids", "secondary_scores", "sub_targets")


def split_by_channel(df: DataFrame, channels: int) -> list[DataFrame]:
    """One branch a channel; others vanish."""
    return [df.where(F.col("channel_index") == k) for k in range(channels)]


def fan_out(df: DataFrame, branches: Sequence[Callable[[DataFrame], DataFrame]]) -> list[DataFrame]:
    """Every branch of all rows."""
    return [df.transform(f) for f in branches]


def merge_streams(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def sync_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames of either branch (channel_index, frame_index, targets ARRAY, mask), with the targets of both, a's first, and the first mask there is."""
    y = b.select(*FRAME, F.col("targets").alias("_t"), F.col("mask").alias("_m"))
    both = a.join(y.hint("merge"), FRAME, "full")
    kind = dict(a.dtypes)["targets"]
    empty = F.array().cast(kind)
    return both.select(*FRAME, F.concat(F.coalesce("targets", empty), F.coalesce("_t", empty)).alias("targets"), F.coalesce("mask", "_m").alias("mask"))


def sync_update(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's targets (channel_index, frame_index, target_no, track_id and any of EMPTY and LISTS) with what b's of the same number adds.

    A track_id of -1 and empty values of EMPTY are filled; LISTS grow by b's. Other
    columns stay a's. Only frames on which both have as many targets are merged; others
    keep a's rows. Faces are merged alike, as a table of theirs. b's targets lie beside
    a's as rows of one window, not in a join: each branch is shuffled once by frame, and
    not at all where it is dealt out so. The frame comes first, as what is sorted is told
    apart by its first column fastest.
    """
    own = [c for c in (*EMPTY, *LISTS) if c in a.columns and c in b.columns]
    frame = ["frame_index", "channel_index"]
    beside = b.dropna(subset=frame).select(*FRAME, "target_no", F.struct(F.col("track_id").alias("_id"), *[F.col(c).alias(f"_b_{c}") for c in own]).alias("_theirs"))
    rows = a.withColumn("_mine", F.lit(True)).unionByName(beside, allowMissingColumns=True)
    whole = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = rows.withColumn("_found", F.collect_list(F.when(F.col("target_no").isNotNull(), F.col("_theirs"))).over(whole(*frame, "target_no")))
    alike = F.count("_mine").over(whole(*frame)) == F.count("_theirs").over(whole(*frame))
    mine = found.withColumn("_alike", alike).where("_mine").withColumn("_theirs", F.explode_outer(F.when(F.col("_alike"), F.col("_found"))))
    both = mine.select(*a.columns, "_theirs.*")
    kinds, new = dict(a.dtypes), {"track_id": F.when(F.col("track_id") == -1, F.coalesce("_id", "track_id")).otherwise(F.col("track_id"))}
    for c in own:
        if c in LISTS:
            none = F.array().cast(kinds[c])
            new[c] = F.concat(F.coalesce(c, none), F.coalesce(f"_b_{c}", none))
        else:
            size = F.size(c) if kinds[c].startswith("array") else F.length(c)
            new[c] = F.when(F.coalesce(size, F.lit(0)) <= 0, F.coalesce(f"_b_{c}", c)).otherwise(F.col(c))
    return both.withColumns(new).select(*a.columns)


def sync_timeouts(a: DataFrame, b: DataFrame, timeout_ms: int = 40, fps: int = 25) -> DataFrame:
    """Frames of either branch and whether they went on alone, because the other had none and a newer frame was timeout_ms away."""
    both = a.select(*FRAME, F.lit(True).alias("in_a")).join(b.select(*FRAME, F.lit(True).alias("in_b")).hint("merge"), FRAME, "full")
    newest = both.groupBy(F.col("channel_index").alias("_c")).agg(F.max("frame_index").alias("newest"))
    late = (F.col("newest") - F.col("frame_index")) * 1000 / fps >= timeout_ms
    alone = F.col("in_a").isNull() | F.col("in_b").isNull()
    return both.join(newest.hint("merge"), F.col("channel_index") == F.col("_c")).select(*FRAME, alone.alias("alone"), (alone & late).alias("timed_out"))


def dedupe_controls(controls: DataFrame, order: Sequence[str]) -> DataFrame:
    """Controls whose uid is not that of the channel's control just before."""
    with_before = previous(controls, ["channel_index"], order, F.col("control_uid"), "_b")
    return with_before.where(~F.col("control_uid").eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_b")


def _stretch(df: DataFrame, column: str) -> Column:
    """Stretches of an ordering column: hours of a time, thousands of a number, else one."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.date_trunc("hour", column)
    return F.floor(F.col(column) / 1000) if kind in ("int", "bigint", "double", "float") else F.lit(0)


def pair_channels(arrivals: DataFrame, src: int, dst: int, group: Sequence[str] = (), order: Sequence[str] = ("create_time", "channel_index", "frame_index")) -> DataFrame:
    """(src_frame, dst_frame) pairs: each src frame with the dst frame that arrived right before it.

    Arrivals of the two channels are put in order within `group`, the columns that tell
    pairs of streams apart. Without a group they are put in order within a stretch of the
    first ordering column; a stretch's first arrival follows the last one of the stretch
    before. So even one pair of channels is many windows.
    """
    own = F.struct("channel_index", "frame_index")
    chosen = arrivals.where(F.col("channel_index").isin(src, dst)).select(*group, *dict.fromkeys(["channel_index", "frame_index", *order]))
    if group:
        marked = chosen.withColumn("was", F.lag(own).over(Window.partitionBy(*group).orderBy(*order)))
        return _pairs(marked, src, dst, group)
    two = written(chosen.withColumn("_s", _stretch(arrivals, order[0])), "arrivals")
    arrived = Window.partitionBy("_s").orderBy(*order)
    ends = two.groupBy("_s").agg(F.max_by(own, F.struct(*order)).alias("end"))
    # one row a stretch
    ends = ends.withColumn("before", F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("_s"))).select(F.col("_s").alias("_k"), "before")
    both = two.join(ends.hint("merge"), F.col("_s").eqNullSafe(F.col("_k")))
    return _pairs(both.withColumn("was", F.coalesce(F.lag(own).over(arrived), F.col("before"))), src, dst, group)


def _pairs(marked: DataFrame, src: int, dst: int, group: Sequence[str]) -> DataFrame:
    return marked.where((F.col("channel_index") == src) & (F.col("was.channel_index") == dst)).select(*group, F.col("frame_index").alias("src_frame"), F.col("was.frame_index").alias("dst_frame"))


def project_targets(pairs: DataFrame, targets: DataFrame, src: int, h: Sequence[float]) -> DataFrame:
    """The src channel's targets of paired frames, with their corners in the dst channel's picture."""
    own = targets.where(F.col("channel_index") == src).join(pairs.hint("merge"), F.col("frame_index") == F.col("src_frame"))
    far = project_point(F.col("x") + F.col("width"), F.col("y") + F.col("height"), h)
    near = project_point(F.col("x"), F.col("y"), h)
    r = lambda c: F.round(c, 4)
    return own.select("track_id", "src_frame", "dst_frame", r(near["x"]).alias("left"), r(near["y"]).alias("top"), r(far["x"]).alias("right"), r(far["y"]).alias("bottom"))
