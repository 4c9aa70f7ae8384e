"""Behaviour over tracks: line crossings, stops and traffic jams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.functions.geometry import distance, point_in_polygon, side_of_line
from vidlake.operators.joins import join_small
from vidlake.operators.ordered import previous
from vidlake.operators.storage import written
from vidlake.operators.track import one_per_track, with_point_before

#: Event codes, one bit each (fixed values).
NONE, CROSSLINE, STOP, UNSTOP, JAM, UNJAM = 0, 1, 2, 4, 8, 16
LABELS = {CROSSLINE: "cross line", STOP: "stop", UNSTOP: "unstop", JAM: "jam", UNJAM: "unjam"}
#: Frames between the compared points, hits that make a stop, stopped tracks that make a jam, seconds between jam events.
CHECK_INTERVAL, MIN_HITS, MIN_STOPS, NOTIFY_SECONDS = 20, 50, 8, 10
STOP_DISTANCE, JAM_DISTANCE = 5, 8
#: Corners of a region up to which its edges are spelled out in the plan.
SPELLED_CORNERS = 16


def event_code(name: str) -> int:
    return {"crossline": CROSSLINE, "stop": STOP, "unstop": UNSTOP, "jam": JAM, "unjam": UNJAM}[name]


def set_flag(flags: Column, code: int) -> Column:
    return flags.bitwiseOR(F.lit(code))


def has_flag(flags: Column, code: int) -> Column:
    return flags.bitwiseAND(F.lit(code)) != 0


def clear_flag(flags: Column, code: int) -> Column:
    return flags.bitwiseAND(F.lit(~code))


def _event(code: int) -> list[Column]:
    return [F.lit(code).alias("ba_type"), F.lit(LABELS[code]).alias("ba_label")]


def cross_line(history: DataFrame, lines: DataFrame) -> DataFrame:
    """An event for each track point on the other side of its channel's line than the point before.

    lines: (channel_index, line), one row a channel. Channels without a line have no events.
    """
    both = join_small(history.where("prev is not null"), lines.select("channel_index", "line"), "channel_index", stored=False)
    crossed = both.where(side_of_line(F.col("point"), F.col("line")) != side_of_line(F.col("prev"), F.col("line")))
    return crossed.select("channel_index", "frame_index", *_event(CROSSLINE), "track_id", F.col("line").alias("region"))


def crossline_totals(events: DataFrame) -> DataFrame:
    """Per channel and frame with crossings: how many, and how many so far. Frames are summed before the running total."""
    per_frame = events.groupBy("channel_index", "frame_index").agg(F.count(F.lit(1)).alias("crossings"))
    before = Window.partitionBy("channel_index").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return per_frame.withColumn("total", F.sum("crossings").over(before))


def stop_hits(history: DataFrame, regions: DataFrame, max_distance: float = STOP_DISTANCE, interval: int = CHECK_INTERVAL, once: bool = True) -> DataFrame:
    """Rows whose track has stood: in its region, and within max_distance of the point interval - 1 rows earlier.

    once: one row for each channel, frame and track. Runs of hits do not need that, and without it rows stay in the order of their track.
    """
    placed = with_point_before(history, interval - 1, "earlier").where("earlier is not null")
    # the distance first: the region costs more
    near = placed.where(distance(F.col("point"), F.col("earlier")) <= max_distance)
    corners = regions.agg(F.max(F.size("ring"))).first()[0]
    spelled = corners if corners is not None and 0 <= corners <= SPELLED_CORNERS else None
    inside = join_small(near, regions.select("channel_index", "ring"), "channel_index", stored=False).where(point_in_polygon(F.col("point"), F.col("ring"), spelled))
    return one_per_track(inside) if once else inside


def frame_ordinals(frames: DataFrame) -> DataFrame:
    """Each channel's frames with their place ford, 1 on, and the frame after; every frame counts, also one without targets."""
    order = Window.partitionBy("channel_index").orderBy("frame_index")
    return frames.select("channel_index", "frame_index").distinct().withColumns({"ford": F.row_number().over(order), "next_frame": F.lead("frame_index").over(order)})


def _runs(hits: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The runs of hits in consecutive channel frames, in pieces: (channel_index, track_id, island, start, end, ford, next_frame, before).

    A track's hits are first put together to stretches of frame numbers without a gap (a
    frame with several hits of a track counts once), so ends of stretches meet the channel's frames and not hits. A stretch whose ends lie as
    far apart among the channel's frames is a piece; one with frames that the channel
    does not have goes on as its single frames, and those frames are dropped. island:
    the name of a run; before: how many hits of it come before the piece.
    """
    track = Window.partitionBy("track_id", "channel_index").orderBy("frame_index")
    alike = hits.where("frame_index is not null").select("channel_index", "track_id", "frame_index", (F.col("frame_index") - F.dense_rank().over(track)).alias("_s"))
    stretches = alike.groupBy("channel_index", "track_id", "_s").agg(F.min("frame_index").alias("start"), F.max("frame_index").alias("end")).drop("_s")
    at = lambda end, *more: ordinals.select("channel_index", F.col("frame_index").alias(end), *more).hint("merge")
    joined = stretches.join(at("start", "ford"), ["channel_index", "start"], "left").join(at("end", F.col("ford").alias("_last"), "next_frame"), ["channel_index", "end"], "left")
    placed = written(joined.withColumn("_whole", F.coalesce(F.col("_last") - F.col("ford") == F.col("end") - F.col("start"), F.lit(False))), "stretches")
    names = ["channel_index", "track_id", "start", "end", "ford", "next_frame"]
    single = placed.where(~F.col("_whole")).select("channel_index", "track_id", F.explode(F.sequence("start", "end")).alias("start"))
    pieces = placed.where("_whole").select(names).unionByName(single.join(at("start", "ford", "next_frame"), ["channel_index", "start"]).withColumn("end", F.col("start")).select(names))
    earlier = Window.partitionBy("channel_index", "track_id").orderBy("ford").rowsBetween(Window.unboundedPreceding, -1)
    summed = pieces.withColumn("_all", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(earlier), F.lit(0))).withColumn("island", F.col("ford") - F.col("_all"))
    return summed.withColumn("before", F.col("_all") - F.min("_all").over(Window.partitionBy("channel_index", "track_id", "island"))).drop("_all")


def _from_hit(n: int) -> Column:
    """The first frame of a piece that is the n-th hit of its run or a later one; beyond the piece's end where none is."""
    return F.greatest(F.col("start"), (F.col("start") + n - 1 - F.col("before")))


def stop_events(hits: DataFrame, frames: DataFrame, min_hits: int = MIN_HITS) -> DataFrame:
    """STOP at the min_hits-th consecutive hit of a track, UNSTOP at the channel's first frame after such a run; a run that is open at the end has no UNSTOP."""
    kind = frames.schema["frame_index"].dataType
    begun = F.when((F.col("before") < min_hits) & (_from_hit(min_hits) <= F.col("end")), _from_hit(min_hits).cast(kind))
    runs = _runs(hits, frame_ordinals(frames)).groupBy("channel_index", "track_id", "island").agg(F.max(begun).alias("begun"), F.max_by("next_frame", "ford").alias("over"))
    event = lambda at, code: F.struct(at.alias("frame_index"), *_event(code))
    both = runs.where("begun is not null").select("channel_index", "track_id", F.explode(F.array(event(F.col("begun"), STOP), event(F.col("over"), UNSTOP))).alias("e"))
    return both.where("e.frame_index is not null").select("channel_index", "e.frame_index", "e.ba_type", "e.ba_label", "track_id")


#: Frame numbers of a stretch in which stopped tracks meet their frames: 2 to this power.
STRETCH_BITS = 6


def stopped_now(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Per channel frame: how many tracks are stopped then, stops so far, and ids, the stopped tracks in order.

    Events are summed by frame, so only frames are windowed. A stop's span goes to the
    stretches of frame numbers that it touches, and a frame takes from its stretch those
    that it lies in: what is shuffled are spans and not a row for each of their frames.
    Events of other kinds do not count.
    """
    own = events.where(F.col("ba_type").isin(STOP, UNSTOP))
    change = own.groupBy("channel_index", "frame_index").agg(
        F.sum(F.when(F.col("ba_type") == STOP, 1).otherwise(-1)).alias("change"), F.sum(F.when(F.col("ba_type") == STOP, 1).otherwise(0)).alias("new")
    )
    every = frames.select("channel_index", "frame_index").distinct()
    joined = every.join(change.hint("merge"), ["channel_index", "frame_index"], "left")
    so_far = Window.partitionBy("channel_index").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    counted = joined.select("channel_index", "frame_index", F.coalesce(F.sum("change").over(so_far), F.lit(0)).alias("stopped"), F.coalesce(F.sum("new").over(so_far), F.lit(0)).alias("stops"))
    # a span that is open ends with its channel
    ends = every.groupBy("channel_index").agg(F.max("frame_index").alias("_end"))
    spans = stopped_ids(own).join(ends.hint("merge"), "channel_index").withColumn("_to", F.coalesce(F.col("to_frame") - 1, F.col("_end"))).where("from_frame <= _to")
    stretch = lambda c: F.shiftright(c, STRETCH_BITS)
    placed = spans.select("channel_index", F.explode(F.sequence(stretch("from_frame"), stretch("_to"))).alias("_stretch"), F.struct("track_id", "from_frame", "_to").alias("_span"))
    lists = placed.groupBy("channel_index", "_stretch").agg(F.collect_list("_span").alias("_spans"))
    both = counted.withColumn("_stretch", stretch("frame_index")).join(lists.hint("merge"), ["channel_index", "_stretch"], "left")
    within = F.filter("_spans", lambda s: F.col("frame_index").between(s["from_frame"], s["_to"]))
    ids = F.coalesce(F.array_sort(F.transform(within, lambda s: s["track_id"])), F.array().cast("array<bigint>"))
    return both.select("channel_index", "frame_index", "stopped", "stops", ids.alias("ids"))


def stopped_ids(events: DataFrame) -> DataFrame:
    """(channel_index, track_id, from_frame, to_frame): when each track was stopped; to_frame is null while it lasts."""
    track = Window.partitionBy("channel_index", "track_id").orderBy("frame_index")
    return events.withColumn("to_frame", F.lead("frame_index").over(track)).where(F.col("ba_type") == STOP).select("channel_index", "track_id", F.col("frame_index").alias("from_frame"), "to_frame")


def jam_counts(history: DataFrame, regions: DataFrame, frames: DataFrame, min_hits: int = MIN_HITS, max_distance: float = JAM_DISTANCE) -> DataFrame:
    """Every channel frame, in order, with how many tracks have stood for min_hits frames."""
    ordinals = frame_ordinals(frames)
    runs = _runs(stop_hits(history, regions, max_distance, CHECK_INTERVAL, False), ordinals).where(_from_hit(min_hits) <= F.col("end"))
    change = lambda at, by: F.struct(at.cast(frames.schema["frame_index"].dataType).alias("frame_index"), F.lit(by).alias("by"))
    changes = runs.select("channel_index", F.explode(F.array(change(_from_hit(min_hits), 1), change(F.col("next_frame"), -1))).alias("e"))
    summed = changes.groupBy("channel_index", F.col("e.frame_index").alias("frame_index")).agg(F.sum("e.by").alias("by"))
    # standing tracks are summed over the channel's frames, a row a frame
    so_far = Window.partitionBy("channel_index").orderBy("ford").rowsBetween(Window.unboundedPreceding, 0)
    counted = ordinals.join(summed.hint("merge"), ["channel_index", "frame_index"], "left").select("channel_index", "frame_index", F.sum("by").over(so_far).alias("stops"))
    joined = frames.select("channel_index", "frame_index", "fps").distinct().join(counted.hint("merge"), ["channel_index", "frame_index"], "left")
    return joined.withColumn("stops", F.coalesce("stops", F.lit(0)))


def jam_events(counts: DataFrame, min_stops: int = MIN_STOPS, notify: int = NOTIFY_SECONDS) -> DataFrame:
    """JAM and UNJAM events of jam_counts.

    JAM at a frame with min_stops or more standing tracks, when the channel is not jammed
    and more than notify seconds of frames lie since its last event (0 at first); UNJAM at
    the first frame with fewer. Only runs of full frames are folded, each as the ends of
    its stretches of consecutive frame numbers, so what a channel gathers is its jams and
    not their frames.
    """
    ordered = Window.partitionBy("channel_index").orderBy("frame_index")
    full = counts.withColumn("full", F.col("stops") >= min_stops)
    marks = full.withColumn("new", (F.col("full") != F.coalesce(F.lag("full").over(ordered), ~F.col("full"))).cast("int"))
    marks = marks.withColumn("cut", F.greatest(F.col("new"), (F.col("frame_index") - F.lag("frame_index").over(ordered) != 1).cast("int")))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    runs = marks.withColumns({"run": F.sum("new").over(so_far), "stretch": F.sum("cut").over(so_far), "after": F.lead("frame_index").over(ordered)})
    stretches = runs.where("full").groupBy("channel_index", "run", "stretch").agg(F.max("fps").alias("fps"), F.min("frame_index").alias("start"), F.max("frame_index").alias("end"), F.max_by("after", "frame_index").alias("after"))
    islands = stretches.groupBy("channel_index", "run").agg(F.max("fps").alias("fps"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("stretches"), F.max_by("after", "end").alias("after"))
    rows = islands.groupBy("channel_index").agg(F.sort_array(F.collect_list(F.struct("run", "stretches", "after", "fps"))).alias("islands"))

    def fold(state: Column, island: Column) -> Column:
        limit = state["last"] + notify * island["fps"]
        first = F.get(F.filter(island["stretches"], lambda s: s["end"] > limit), 0)
        at = F.when(first.isNotNull(), F.greatest(first["start"], (limit + 1).cast("int")))
        entered = F.when(at.isNotNull(), F.array(F.struct(at.alias("frame_index"), F.lit(JAM).alias("ba_type")))).otherwise(F.array().cast("array<struct<frame_index:int,ba_type:int>>"))
        left = F.when(at.isNotNull() & island["after"].isNotNull(), F.array(F.struct(island["after"].alias("frame_index"), F.lit(UNJAM).alias("ba_type")))).otherwise(F.array().cast("array<struct<frame_index:int,ba_type:int>>"))
        return F.struct(F.when(at.isNull(), state["last"]).otherwise(F.coalesce(island["after"], at)).alias("last"), F.concat(state["events"], entered, left).alias("events"))

    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<frame_index:int,ba_type:int>>").alias("events"))
    folded = rows.select("channel_index", F.explode(F.aggregate("islands", start, fold)["events"]).alias("e"))
    return folded.select("channel_index", F.col("e.frame_index").alias("frame_index"), F.col("e.ba_type").alias("ba_type"), F.when(F.col("e.ba_type") == JAM, LABELS[JAM]).otherwise(LABELS[UNJAM]).alias("ba_label"))


def jam_status(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Every channel frame with jammed: whether the last jam event up to it was a JAM; where events have target_ids, also those of that event."""
    named = [c for c in ("target_ids",) if c in events.columns]
    joined = frames.select("channel_index", "frame_index").distinct().join(events.select("channel_index", "frame_index", F.struct("ba_type", *named).alias("e")).hint("merge"), ["channel_index", "frame_index"], "left")
    last = F.last("e", ignorenulls=True).over(Window.partitionBy("channel_index").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0))
    out = joined.withColumn("_e", last)
    return out.select("channel_index", "frame_index", F.coalesce(F.col("_e.ba_type") == JAM, F.lit(False)).alias("jammed"), *[F.col(f"_e.{c}") for c in named])


def targets_by_ids(targets: DataFrame, events: DataFrame) -> DataFrame:
    """Targets of an event's frame whose track is in its target_ids (array)."""
    ids = events.select("channel_index", "frame_index", F.explode("target_ids").alias("track_id")).distinct()
    return targets.join(ids.hint("merge"), ["channel_index", "frame_index", "track_id"], "left_semi")


def track_flags(events: DataFrame) -> DataFrame:
    """Per track: the bits of all events it took part in."""
    return events.groupBy("channel_index", "track_id").agg(F.bit_or("ba_type").alias("ba_flags"))


def state_changes(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Rows at which state differs from the row before of the same keys; the first row of keys is not a change."""
    return previous(df, keys, [order], F.col(state), "was").where(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col(state)))
