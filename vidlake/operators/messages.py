"""Messages: JSON, XML and line-oriented text of frames, events and targets, and what is sent once."""

from __future__ import annotations

import logging
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from vidlake.functions.text import parse_plate, time_format
from vidlake.operators.storage import deleted, written

log = logging.getLogger(__name__)

OPEN, CLOSE = "<--", "-->"
TIME = "<year>-<mon>-<day> <hour>:<min>:<sec>.<mili>"


def frame_messages(frames: DataFrame, targets: DataFrame, kind: str, fields: Sequence[str]) -> DataFrame:
    """One struct m a frame: channel, frame, size, fps, kind, how many targets, and their fields in order of target_no."""
    lists = targets.groupBy("channel_index", "frame_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("target_no", *fields))), lambda t: F.struct(*[t[f].alias(f) for f in fields])).alias("items"))
    both = frames.join(lists.hint("merge"), ["channel_index", "frame_index"])
    return both.select("channel_index", "frame_index", F.struct("channel_index", "frame_index", "width", "height", "fps", F.lit(kind).alias("broke_for"), F.size("items").alias(f"{kind}_size"), F.col("items").alias(f"{kind}_targets")).alias("m"))


def to_json_messages(frames: DataFrame, targets: DataFrame, kind: str, fields: Sequence[str]) -> DataFrame:
    return frame_messages(frames, targets, kind, fields).select("channel_index", "frame_index", F.to_json("m").alias("message"))


def to_xml_messages(frames: DataFrame, targets: DataFrame, kind: str, fields: Sequence[str]) -> DataFrame:
    return frame_messages(frames, targets, kind, fields).select("channel_index", "frame_index", F.to_xml("m", {"rowTag": "message"}).alias("message"))


#: The fields of each kind of target in a message, in order (fixed values).
TARGET_FIELDS = (
    "x", "y", "width", "height", "primary_class_id", "primary_score", "primary_label", "channel_index", "frame_index", "track_id",
    "secondary_class_ids", "secondary_scores", "secondary_labels", "sub_targets", "embeddings",
)
SUB_TARGET_FIELDS = ("x", "y", "width", "height", "class_id", "score", "label", "frame_index", "channel_index", "attachments")
FACE_FIELDS = ("x", "y", "width", "height", "score", "embeddings", "key_points", "track_id")
TEXT_FIELDS = ("text", "score", "region", "flags")
KIND_FIELDS = {"normal": TARGET_FIELDS, "face": FACE_FIELDS, "text": TEXT_FIELDS, "pose": ()}
_LISTS = ("secondary_class_ids", "secondary_scores", "secondary_labels", "sub_targets", "embeddings", "key_points", "region", "attachments")


def with_fields(targets: DataFrame, fields: Sequence[str]) -> DataFrame:
    """targets with the fields of a kind: what they lack is an empty list, no track (-1), or an empty text or zero."""
    missing = [f for f in fields if f not in targets.columns]
    none = lambda f: F.array() if f in _LISTS else F.lit(-1) if f == "track_id" else F.lit("") if f.endswith("label") or f in ("text", "flags") else F.lit(0)
    return targets.withColumns({f: none(f) for f in missing})


def with_sub_targets(targets: DataFrame, parts: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
    """targets with sub_targets: their parts (channel_index, frame_index, target_no, part_no and box fields) in order, each with the fields of a sub-target.

    Parts lie beside their targets as rows of one window, not in a join: so what is dealt
    out by frame stays there, and no target keeps a grouping's buffer. The frame comes
    first, as what is sorted is told apart by its first column fastest. dealt: columns of
    both that follow from a frame, by which rows are dealt out.
    """
    full = with_fields(parts, SUB_TARGET_FIELDS)
    keys = ["frame_index", "channel_index", "target_no", *dealt]
    beside = full.dropna(subset=keys).select(*keys, F.col("part_no").alias("_no"), F.struct(*SUB_TARGET_FIELDS).alias("_part"))
    own = Window.partitionBy(*keys).orderBy("_no", "_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = targets.drop("sub_targets").unionByName(beside, allowMissingColumns=True).withColumn("sub_targets", F.collect_list("_part").over(own))
    return both.where("_part is null").drop("_no", "_part")


def kind_messages(frames: DataFrame, targets: DataFrame, kind: str, xml: bool = False, dealt: Sequence[str] = ()) -> DataFrame:
    """A message a frame with all fields that targets of the kind have: normal, face, text or pose (which has none).

    dealt: columns of both that follow from a frame, by which rows are dealt out.
    """
    full = with_fields(targets, KIND_FIELDS[kind])
    # a target's own channel and frame are fields too: kept under other names, as the keys of a frame are grouped by
    named = full.withColumns({f"_{c}": F.col(c) for c in ("channel_index", "frame_index")})
    shown = [F.col(f"_{f}").alias(f) if f in ("channel_index", "frame_index") else F.col(f) for f in KIND_FIELDS[kind]]
    items = named.groupBy("channel_index", "frame_index", *dealt).agg(F.transform(F.sort_array(F.collect_list(F.struct("target_no", F.struct(*shown).alias("t")))), lambda t: t["t"]).alias("items"))
    if dealt:
        # frames meet by the columns that both are dealt by, as a list of each, which is short
        lists = frames.groupBy("channel_index", *dealt).agg(F.collect_list(F.struct("frame_index", "width", "height", "fps")).alias("_frames"))
        both = items.join(lists.hint("shuffle_hash"), ["channel_index", *dealt]).withColumn("_f", F.explode(F.filter("_frames", lambda f: f["frame_index"] == F.col("frame_index"))))
        both = both.select("channel_index", "frame_index", "items", "_f.width", "_f.height", "_f.fps")
    else:
        both = frames.join(items.hint("merge"), ["channel_index", "frame_index"])
    m = both.select(
        "channel_index", "frame_index", F.struct("channel_index", "frame_index", "width", "height", "fps", F.lit(kind).alias("broke_for"), F.size("items").alias(f"{kind}_size"), F.col("items").alias(f"{kind}_targets")).alias("m"),
    )
    return m.select("channel_index", "frame_index", (F.to_xml("m", {"rowTag": "message"}) if xml else F.to_json("m")).alias("message"))


def _block(*lines: Column) -> Column:
    return F.concat_ws("\n", F.lit(OPEN), *lines, F.lit(CLOSE))


def _place() -> Column:
    return F.concat_ws(",", F.col("channel_index").cast("string"), F.col("frame_index").cast("string"))


def _meant(targets: DataFrame, ids: DataFrame, tasks: int | None) -> DataFrame:
    """The targets that ids (channel_index, frame_index, track_id) name.

    They are found by track alone, by which targets are often dealt out already: a
    track's frames are joined as a list, so only what is meant goes on.
    """
    named = ids.select("channel_index", "track_id", "frame_index")
    named = named.repartition(tasks, "channel_index", "track_id") if tasks else named
    lists = named.groupBy("channel_index", "track_id").agg(F.collect_set("frame_index").alias("_frames"))
    both = targets.join(lists.hint("shuffle_hash"), ["channel_index", "track_id"])
    return both.where(F.array_contains("_frames", F.col("frame_index"))).drop("_frames")


def ba_messages(events: DataFrame, targets: DataFrame, zone: str = "UTC", tasks: int | None = None) -> DataFrame:
    """A block of lines for each event (event_time, ba_type, ba_label, target_ids, region, image_name, video_name) with the labels of its targets.

    Labels of a target have pipes between, targets commas, in order of track_id. Events
    with no target on their frame have an empty line there. tasks: into how many tasks
    targets are dealt by channel and track, where they are; they then stay there.
    """
    own_key = F.xxhash64("channel_index", "frame_index", "ba_type", "ba_label", "target_ids")  # an event's key is what it says: it survives the loss of a task
    keyed = events if "event_no" in events.columns else events.withColumn("event_no", own_key)
    ids = keyed.select("event_no", "channel_index", "frame_index", F.explode("target_ids").alias("track_id")).distinct()
    own = _meant(targets, ids, tasks).select("channel_index", "frame_index", "track_id", F.array_join("secondary", "|").alias("labels"))
    labels = ids.join(own.hint("merge"), ["channel_index", "frame_index", "track_id"]).groupBy("event_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("track_id", "labels"))), lambda t: t["labels"]), ",").alias("labels"))
    both = keyed.join(labels.hint("merge"), "event_no", "left")
    region = F.array_join(F.transform("region", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), ",")
    text = _block(
        time_format(F.col("event_time"), TIME, zone), _place(), F.concat_ws(",", F.col("ba_type").cast("string"), "ba_label"), F.array_join(F.col("target_ids").cast("array<string>"), ","),
        region, F.coalesce("labels", F.lit("")), F.coalesce("image_name", F.lit("")), F.coalesce("video_name", F.lit("")),
    )
    return both.select("channel_index", "frame_index", "ba_type", text.alias("message"))


def crop_name(folder: str, number: Column) -> Column:
    return F.concat(F.lit(f"{folder}/"), F.concat_ws("_", F.col("channel_index").cast("string"), F.col("frame_index").cast("string"), number.cast("string")), F.lit(".jpg"))


@F.arrow_udf(StringType())
def _vector(v: pa.Array) -> pa.Array:
    """Numbers with six significant digits and no trailing zeros, rounded by their exact value (a tie to the even digit), as C does; Java's format rounds shortest decimals up."""
    return pa.array([None if row is None else ",".join(["%.6g" % x for x in row if x is not None]) for row in v.to_pylist()], pa.string())


def embedding_messages(targets: DataFrame, folder: str) -> DataFrame:
    """A block a target (track_id, target_no, embedding): the name of its crop and its vector with six digits."""
    number = F.when(F.col("track_id") >= 0, F.col("track_id")).otherwise(F.col("target_no"))
    return targets.where(F.size("embedding") > 0).select("channel_index", "frame_index", "target_no", _block(crop_name(folder, number), _vector(F.col("embedding"))).alias("message"))


def property_messages(targets: DataFrame, folder: str) -> DataFrame:
    """As embedding_messages, and a line of the secondary labels and one of the first sub-target's label."""
    number = F.when(F.col("track_id") >= 0, F.col("track_id")).otherwise(F.col("target_no"))
    text = _block(crop_name(folder, number), _vector(F.col("embedding")), F.array_join("secondary", ","), F.coalesce("sub_label", F.lit("")))
    return targets.where(F.size("embedding") > 0).select("channel_index", "frame_index", "target_no", text.alias("message"))


def plate_messages(plates: DataFrame, folder: str, zone: str = "UTC") -> DataFrame:
    """A block a plate (plate_time, track_id, label): time, place, crop, whole picture, colour and text; labels that are no plate send nothing."""
    plate = parse_plate(F.col("label"))
    whole = F.concat(F.lit(f"{folder}/"), F.concat_ws("_", F.col("channel_index").cast("string"), F.col("frame_index").cast("string")), F.lit(".jpg"))
    text = _block(time_format(F.col("plate_time"), TIME, zone), _place(), crop_name(folder, F.col("track_id")), whole, plate["color"], plate["text"])
    return plates.where(plate.isNotNull()).select("channel_index", "frame_index", "track_id", text.alias("message"))


def skip_empty(messages: DataFrame) -> DataFrame:
    return messages.where(F.length("message") > 0)


def first_per_track(history: DataFrame, min_tracked: int = 25, min_width: int = 50, min_height: int = 50, only_for_tracked: bool = False) -> DataFrame:
    """Each track's first target that is large enough and, of tracked ones, has been followed for min_tracked targets; untracked rows always pass where they may."""
    sized = history.where((F.col("width") >= min_width) & (F.col("height") >= min_height))
    tracked = F.col("track_id") >= 0
    qualify = sized.where(tracked & (F.col("history") >= min_tracked)) if only_for_tracked else sized
    order = Window.partitionBy("track_id", "channel_index").orderBy("frame_index")
    first = qualify.where(tracked).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first if only_for_tracked else first.unionByName(sized.where(~tracked))


def plates_first_per_text(plates: DataFrame) -> DataFrame:
    """Each plate text's first row per channel, of each track's first row only: two independent steps."""
    parsed = plates.withColumn("plate", parse_plate(F.col("label"))).where("plate is not null").withColumn("text", F.col("plate.text")).drop("plate")
    once = lambda df, key: df.withColumn("_n", F.row_number().over(Window.partitionBy("channel_index", key).orderBy("frame_index", "track_id"))).where("_n = 1").drop("_n")
    return once(once(parsed, "track_id"), "text")


def plates_to_send(plates: DataFrame, min_width: int = 100, min_height: int = 0) -> DataFrame:
    """The first row (channel_index, frame_index, track_id, color, text) of each track and text of plates that are large enough and well formed."""
    parsed = plates.withColumn("plate", parse_plate(F.col("label")))
    good = parsed.where((F.col("track_id") >= 0) & (F.col("width") >= min_width) & (F.col("height") >= min_height) & F.col("plate").isNotNull())
    rows = good.groupBy("channel_index", "track_id", F.col("plate.text").alias("text")).agg(F.min(F.struct("frame_index", "plate.color")).alias("at"))
    return rows.select("channel_index", F.col("at.frame_index").alias("frame_index"), "track_id", F.col("at.color").alias("color"), "text")


def first_of_both(rows: DataFrame, group: str, one: str, other: str, order: Sequence[str]) -> DataFrame:
    """Rows of a group taken in order, each unless an earlier taken row has its `one` or its `other`: the ordered maximal matching.

    Each round takes the rows that are first of both their `one` and their `other`, as
    nothing before them can hold them back, and drops the rows that these hold back.
    Rounds follow chains of rows that wait for one another, of which sets in no special
    order have few; each is a written table, and how many rows it takes is logged.
    order: columns that tell a group's rows apart. Firsts are found by grouping, so a
    value that many rows share is one row a task; rows are dropped by joins, which
    adaptive execution splits.
    """
    place = F.struct(*order).alias("place")
    every = written(rows.select("*", place), "waiting")
    left, out, n = every.select(group, one, other, "place"), None, 0
    while True:
        firsts = [left.groupBy(group, key).agg(F.min("place").alias("place")) for key in (one, other)]
        named = firsts[1].select(F.col(group).alias("_g"), F.col("place").alias("_p"), other)
        taken = written(firsts[0].join(named.hint("merge"), (F.col(group) == F.col("_g")) & (F.col("place") == F.col("_p"))).select(group, one, other, "place"), "taken")
        n += 1
        count = taken.count()
        if not count:
            deleted(left, taken)
            log.info("matching: %d rounds", n - 1)
            return every.drop("place") if out is None else every.join(out.hint("merge"), [group, "place"], "left_semi").drop("place")
        log.info("matching: round %d takes %d rows", n, count)
        own = taken.select(group, "place")
        out = own if out is None else out.unionByName(own)
        rest = left
        for key in (one, other):
            rest = rest.join(taken.select(group, key).hint("merge"), [group, key], "left_anti")
        was, left = left, written(rest, "waiting")
        deleted(was)


def first_per_plate(plates: DataFrame, partitions: int | None = None, min_width: int = 100, min_height: int = 0) -> DataFrame:
    """Plates (channel_index, frame_index, track_id, width, height, label) that are sent: each text and each track once per channel.

    A row that its text holds back does not use up its track, so rows count in order of
    frame, track and text; only the first row of each track and text can be sent. The
    order is followed by rounds over all channels at once (first_of_both), not by a task
    a channel. partitions: in how many files the rows are written first.
    """
    rows = plates_to_send(plates, min_width, min_height)
    rows = rows.repartition(partitions, "channel_index", "track_id") if partitions else rows
    return first_of_both(rows, "channel_index", "track_id", "text", ["frame_index", "track_id", "text"])
