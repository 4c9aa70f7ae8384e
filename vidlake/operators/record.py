"""Recording as selection: clips, snapshots, paths and file segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.operators.behaviour import frame_ordinals

#: Seconds before a request, and of a clip after it, unless the request says (fixed values).
PRE_SECONDS, CLIP_SECONDS = 5, 20
#: Seconds that a manual request may ask for (fixed values).
MIN_SECONDS, MAX_SECONDS = 5, 60
#: Frames of a bucket by which ranges of frames are joined.
BUCKET = 250


def controls_from_events(events: DataFrame, images: bool = True, videos: bool = True) -> DataFrame:
    """Record requests of events (kind, frame_ts): an image with overlay, a video without. They stand before their frame."""
    stamp = F.date_format("frame_ts", "yyyyMMddHHmmssSSS")
    one = lambda what, osd: events.select("channel_index", "frame_index", F.lit(f"{what}_record").alias("control_type"), F.concat(F.lower("kind"), F.lit(f"_{what}__"), stamp).alias("file_name"), F.lit(0).alias("duration"), F.lit(osd).alias("osd"))
    parts = [one("image", True)] * images + [one("video", False)] * videos
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def manual_controls(rows: DataFrame) -> DataFrame:
    """Requests whose duration is allowed."""
    return rows.where(F.col("duration").between(MIN_SECONDS, MAX_SECONDS))


def _requests(controls: DataFrame, frames: DataFrame) -> DataFrame:
    """controls (clip_id, channel_index, frame_index, duration) with the ordinal of their first frame and the fps."""
    own = frame_ordinals(frames).join(frames.select("channel_index", "frame_index", "fps").distinct().hint("merge"), ["channel_index", "frame_index"])
    return controls.join(own.hint("merge"), ["channel_index", "frame_index"])


def select_clips(frames: DataFrame, controls: DataFrame, pre: int = PRE_SECONDS, seconds: int = CLIP_SECONDS) -> DataFrame:
    """(clip_id, channel_index, frame_index, n): the frames of each clip, from n = 1.

    Up to pre seconds before the request, then on until (pre + duration) seconds in all:
    what is missing before is made up after. Ranges are cut at buckets of BUCKET frames,
    so they meet the frames in an equi join.
    """
    asked = _requests(controls, frames)
    length = (F.lit(pre) + F.when(F.coalesce("duration", F.lit(0)) > 0, F.col("duration")).otherwise(seconds)) * F.col("fps")
    ranges = asked.withColumn("start", F.greatest(F.lit(1), F.col("ford") - pre * F.col("fps"))).withColumn("end", F.col("start") + length - 1)
    spread = ranges.select("clip_id", "channel_index", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))).alias("bucket"))
    numbered = frame_ordinals(frames).withColumn("bucket", F.floor(F.col("ford") / BUCKET))
    both = numbered.join(spread.hint("merge"), ["channel_index", "bucket"]).where(F.col("ford").between(F.col("start"), F.col("end")))
    return both.select("clip_id", "channel_index", "frame_index", (F.col("ford") - F.col("start") + 1).cast("int").alias("n"))


def select_snapshots(frames: DataFrame, controls: DataFrame) -> DataFrame:
    """(clip_id, channel_index, frame_index): the frame that follows each request, which is the one it stands before."""
    return _requests(controls, frames).select("clip_id", "channel_index", "frame_index")


def record_info(clips: DataFrame, controls: DataFrame, fps: int, pre: int = PRE_SECONDS, seconds: int = CLIP_SECONDS) -> DataFrame:
    """Per clip: frames, first and last, and whether it came to its full length."""
    found = clips.groupBy("clip_id", "channel_index").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))
    length = (F.lit(pre) + F.when(F.coalesce("duration", F.lit(0)) > 0, F.col("duration")).otherwise(seconds)) * fps
    return found.join(controls.select("clip_id", length.alias("length")).hint("merge"), "clip_id").withColumn("complete", F.col("frames") == F.col("length")).drop("length")


def record_path(controls: DataFrame, folder: str, auto_sub_dir: bool = True) -> DataFrame:
    """path of each request (channel_index, frame_ts, file_name, control_type); names that are taken get a number."""
    ext = F.when(F.col("control_type").startswith("image"), ".jpg").otherwise(".mp4")
    parts = [F.lit(folder), *([F.date_format("frame_ts", "yyyy-MM-dd"), F.col("channel_index").cast("string")] if auto_sub_dir else [])]
    stem = controls.withColumn("stem", F.concat_ws("/", *parts, "file_name"))
    nth = F.row_number().over(Window.partitionBy("stem", "control_type").orderBy("frame_index", "clip_id"))
    return stem.withColumn("nth", nth).withColumn("path", F.concat("stem", F.when(F.col("nth") > 1, F.concat(F.lit("_"), F.col("nth").cast("string"))).otherwise(""), ext)).drop("stem", "nth")


def file_segments(frames: DataFrame, minutes: int = 2) -> DataFrame:
    """frames with the number of the file that each goes to; a file has minutes of frames, at most 30."""
    if not 1 <= minutes <= 30:
        raise ValueError("minutes is 1 to 30")
    numbered = frame_ordinals(frames).join(frames.select("channel_index", "frame_index", "fps").distinct().hint("merge"), ["channel_index", "frame_index"])
    segment: Column = F.floor((F.col("ford") - 1) / (minutes * 60 * F.col("fps"))).cast("int")
    return numbered.select("channel_index", "frame_index", segment.alias("segment"))
