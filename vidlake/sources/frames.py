"""Frames, images, pushed rows and controls as tables; sampling and resizing of frames; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vidlake.operators.ordered import numbered, previous

FRAME_SCHEMA = "channel_index int, frame_index int, fps int, width int, height int, create_time timestamp, description string"


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", max_files_per_trigger: int = 100) -> DataFrame:
    """A stream of files whose work per batch is bounded, so that a backlog is worked off and no frame is shed."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).load(path)


def number_frames(rows: DataFrame, order: list[str]) -> DataFrame:
    """frame_index from 0 up per channel, for sources that have none; counted in ranges, so a channel is many tasks."""
    return numbered(rows, ["channel_index"], order, "frame_index").withColumn("frame_index", F.col("frame_index").cast("int"))


def read_images(spark: SparkSession, folder: str, glob: str = "*.jpg", with_content: bool = False) -> DataFrame:
    """(frame_index, path, length[, content]) of a numbered image sequence; the number is the last one in the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    number = F.regexp_extract("path", r"(\d+)\D*$", 1)
    return files.where(number != "").select(number.cast("int").alias("frame_index"), "path", "length", *(["content"] if with_content else []))


def accepted_batches(rows: DataFrame) -> DataFrame:
    """Rows (channel_index, batch_no, width, height, ...) of the batches that an application may push.

    A batch is taken when its frames have one size, which is that of the channel's first
    such batch. Frames get fps 1.
    """
    sizes = rows.groupBy("channel_index", "batch_no").agg(F.min(F.struct("width", "height")).alias("lo"), F.max(F.struct("width", "height")).alias("hi")).where("lo = hi")
    first = sizes.groupBy("channel_index").agg(F.min_by("lo", "batch_no").alias("first"))
    good = sizes.join(first.hint("merge"), "channel_index").where("lo = first").select("channel_index", "batch_no")
    return rows.join(good.hint("merge"), ["channel_index", "batch_no"], "left_semi").withColumn("fps", F.lit(1))


def sample_frames(frames: DataFrame, skip: int) -> DataFrame:
    """Skips `skip` (0 to 9) frames and keeps the next; indexes and fps shrink alike."""
    if not 0 <= skip <= 9:
        raise ValueError("skip is 0 to 9")
    kept = frames.where(F.col("frame_index") % (skip + 1) == skip)
    return kept.withColumns({"frame_index": F.floor(F.col("frame_index") / (skip + 1)).cast("int"), "fps": F.floor(F.col("fps") / (skip + 1)).cast("int")})


def sample_every(frames: DataFrame, seconds: int) -> DataFrame:
    """The first frame of each grid cell of 1 to 60 seconds; frame_ts is a column."""
    if not 1 <= seconds <= 60:
        raise ValueError("seconds is 1 to 60")
    cell = F.floor(F.unix_micros("frame_ts") / (seconds * 1_000_000))
    others = [c for c in frames.columns if c != "channel_index"]
    first = frames.groupBy("channel_index", cell.alias("cell")).agg(F.min_by(F.struct(*others), F.struct("frame_ts", "frame_index")).alias("f"))
    return first.select("channel_index", *[F.col(f"f.{c}").alias(c) for c in others])


def resize(df: DataFrame, ratio: float, columns: tuple[str, ...] = ("width", "height")) -> DataFrame:
    """Sizes, or boxes too, times a ratio in (0, 1], truncated."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio is above 0 and at most 1")
    return df.withColumns({c: (F.col(c) * ratio).cast("int") for c in columns})


def stream_info(frames: DataFrame) -> DataFrame:
    """Per channel: size and fps of its latest frame, and how many frames."""
    latest = F.max_by(F.struct("fps", "width", "height"), "frame_index")
    return frames.groupBy("channel_index").agg(latest.alias("f"), F.count(F.lit(1)).alias("frames")).select("channel_index", "f.fps", "f.width", "f.height", "frames")


def source_info(frames: DataFrame) -> DataFrame:
    """(channel_index, original_fps, original_width, original_height, uri, since_frame): what a source tells of its stream, once and whenever it changes.

    frames have the source's values before sampling and resizing; where one has changed
    since the frame before, the stream is told anew.
    """
    own = F.struct(F.col("fps").alias("original_fps"), F.col("width").alias("original_width"), F.col("height").alias("original_height"), "uri")
    told = previous(frames.withColumn("_own", own), ["channel_index"], ["frame_index"], own, "_was").where(~F.col("_own").eqNullSafe(F.col("_was")))
    return told.select("channel_index", "_own.*", F.col("frame_index").alias("since_frame"))


def frame_time(frames: DataFrame, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """frame_ts: a stream's start and its frame periods."""
    return frames.withColumn("frame_ts", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("frame_index") * F.floor(F.lit(1000) / F.col("fps")) * 1000))


def write_messages(df: DataFrame, sink: str, path: str | None = None, **options: str):
    """Writes messages to a sink of Spark's: text, json, parquet, console or kafka; streams are started and returned."""
    if df.isStreaming:
        writer = df.writeStream.format(sink).options(**options)
        return writer.start(path) if path else writer.start()
    writer = df.write.format(sink).options(**options)
    return writer.save(path) if path else writer.save()
