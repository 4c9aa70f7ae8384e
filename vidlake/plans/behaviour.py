"""Queries of tracks and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidlake import fixtures as X
from vidlake.functions import geometry as G
from vidlake.operators import behaviour as B, track as T
from vidlake.operators.storage import written

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _ring_sql(x: str, y: str) -> str:
    ring, parts = X.REGION, []
    for k, (ax, ay) in enumerate(ring):
        bx, by = ring[k - 1]
        if ay != by:
            parts.append(f"(({ay} > {y}) <> ({by} > {y}) and {x} < ({bx - ax}) * ({y} - {ay}) // ({by - ay}) + {ax})::int")
    return f"(({' + '.join(parts)}) % 2 = 1)"


(_AX, _AY), (_BX, _BY) = sorted(X.LINE)
_SIDE = lambda x, y: f"(({_BX - _AX}) * ({y} - {_AY}) - ({_BY - _AY}) * ({x} - {_AX}) > 0)"

HISTORY = X.FRAMES_SQL + """,
    busy as (select channel_index, frame_index, lag(frame_index) over (partition by channel_index order by frame_index) as busy_before from frames),
    marked as (
        select d.*, x + width // 2 as px, y + height as py,
            coalesce((busy_before - lag(frame_index) over (partition by channel_index, track_id order by frame_index) > 25)::int, 0) as new
        from detections d join busy using (channel_index, frame_index)),
    segged as (select *, (sum(new) over (partition by channel_index, track_id order by frame_index))::bigint as seg from marked),
    history as (
        select *, (row_number() over w)::int as history, lag(px) over w as qx, lag(py) over w as qy, lag(px, 19) over w as ex, lag(py, 19) over w as ey
        from segged window w as (partition by channel_index, track_id, seg order by frame_index)),
    ford as (select channel_index, frame_index, row_number() over (partition by channel_index order by frame_index) as ford from frames)"""
CROSSINGS = HISTORY + f""",
    crossings as (
        select channel_index, frame_index, 1 as ba_type, 'cross line' as ba_label, track_id from history
        where qx is not null and {_SIDE('px', 'py')} <> {_SIDE('qx', 'qy')})"""


def _runs(distance: int) -> str:
    return f"""
        select *, row_number() over (partition by channel_index, track_id, island order by ford) as run from (
            select *, ford - row_number() over (partition by channel_index, track_id order by ford) as island from (
                select h.channel_index, h.track_id, h.frame_index, ford from history h join ford using (channel_index, frame_index)
                where ex is not null and {_ring_sql('px', 'py')} and sqrt((px - ex) ** 2 + (py - ey) ** 2) <= {distance}))"""


STOPS = HISTORY + f""",
    runs as ({_runs(5)}),
    stop_events as (
        select channel_index, frame_index, 2 as ba_type, 'stop' as ba_label, track_id from runs where run = 50
        union all
        select e.channel_index, f.frame_index, 4, 'unstop', track_id
        from (select channel_index, track_id, island, max(ford) as last from runs group by 1, 2, 3 having count(*) >= 50) e
        join ford f on f.channel_index = e.channel_index and f.ford = e.last + 1)"""
JAMS = HISTORY + f""",
    runs as ({_runs(8)}),
    counts as (
        select f.channel_index, f.frame_index, f.ford, coalesce(c.stops, 0) as stops
        from ford f left join (select channel_index, frame_index, count(*) as stops from runs where run >= 50 group by 1, 2) c using (channel_index, frame_index)),
    walk as (
        select channel_index, 0::bigint as ford, 0 as frame_index, false as jammed, 0 as last, 0 as ba_type from (select distinct channel_index from counts)
        union all
        select c.channel_index, c.ford, c.frame_index,
            case when not jammed and stops >= 8 and c.frame_index - last > 250 then true when jammed and stops < 8 then false else jammed end,
            case when (not jammed and stops >= 8 and c.frame_index - last > 250) or (jammed and stops < 8) then c.frame_index else last end,
            case when not jammed and stops >= 8 and c.frame_index - last > 250 then 8 when jammed and stops < 8 then 16 else 0 end
        from walk w join counts c on c.channel_index = w.channel_index and c.ford = w.ford + 1),
    jam_events as (select channel_index, frame_index, ba_type, case ba_type when 8 then 'jam' else 'unjam' end as ba_label from walk where ba_type > 0)"""


def history(spark, d, targets=None, frames=None):
    return T.track_history(X.detections(spark, d) if targets is None else targets, X.tasks(spark, d), frames)


def frames_once(targets):
    """The frames that targets are on, written, as history, ordinals and results all read them."""
    return written(X.frames_of(targets), "frames")


def _crossings(spark, d):
    return B.cross_line(history(spark, d), X.channel_config(spark))


def _stops(spark, d, targets=None, frames=None):
    targets = X.detections(spark, d) if targets is None else targets
    frames = frames_once(targets) if frames is None else frames
    return B.stop_events(B.stop_hits(history(spark, d, targets, frames), X.channel_config(spark), once=False), frames)


def _jam_counts(spark, d, targets=None, frames=None):
    targets = X.detections(spark, d) if targets is None else targets
    frames = frames_once(targets) if frames is None else frames
    return B.jam_counts(history(spark, d, targets, frames), X.channel_config(spark), frames)


@query("geometry_points", f"with {X.DETECTIONS_SQL} select channel_index, frame_index, track_id, x + width // 2 as cx, y + height // 2 as cy, x + width // 2 as px, y + height as py, round(sqrt((x - 320) ** 2 + (y - 200) ** 2), 4) as far from detections")
def geometry_points(spark, d):
    box = [F.col(c) for c in ("x", "y", "width", "height")]
    c, p = G.rect_center(*box), G.track_point(*box)
    mid = F.struct(F.lit(320).alias("x"), F.lit(200).alias("y"))
    return X.detections(spark, d).select("channel_index", "frame_index", "track_id", c["x"].alias("cx"), c["y"].alias("cy"), p["x"].alias("px"), p["y"].alias("py"), F.round(G.distance(F.struct("x", "y"), mid), 4).alias("far"))


@query("geometry_sides", f"with {X.DETECTIONS_SQL} select channel_index, frame_index, track_id, {_SIDE('x', 'y')} as side, {_ring_sql('x', 'y')} as inside, round(i / (width * height + 50 * 60 - i), 6) as iou from (select *, (greatest(0, least(x + width, 350) - greatest(x, 300)) * greatest(0, least(y + height, 160) - greatest(y, 100)))::double as i from detections)")
def geometry_sides(spark, d):
    rows = X.detections(spark, d).join(F.broadcast(X.channel_config(spark)), "channel_index")
    p, fixed = F.struct("x", "y"), F.struct(F.lit(300).alias("x"), F.lit(100).alias("y"), F.lit(50).alias("width"), F.lit(60).alias("height"))
    return rows.select("channel_index", "frame_index", "track_id", G.side_of_line(p, F.col("line")).alias("side"), G.point_in_polygon(p, F.col("ring")).alias("inside"), F.round(G.iou(T.box(), fixed), 6).alias("iou"))


_H = G.homography([(0, 0), (800, 0), (800, 700), (0, 700)], [(10, 20), (760, 0), (800, 640), (0, 700)])


@query("geometry_projection", f"with {X.DETECTIONS_SQL} select channel_index, frame_index, track_id, round(({_H[0]!r} * x + {_H[1]!r} * y + {_H[2]!r}) / ({_H[6]!r} * x + {_H[7]!r} * y + 1.0), 4) as u, round(({_H[3]!r} * x + {_H[4]!r} * y + {_H[5]!r}) / ({_H[6]!r} * x + {_H[7]!r} * y + 1.0), 4) as v from (select channel_index, frame_index, track_id, x::double as x, y::double as y from detections)")
def geometry_projection(spark, d):
    p = G.project_point(F.col("x"), F.col("y"), _H)
    return X.detections(spark, d).select("channel_index", "frame_index", "track_id", F.round(p["x"], 4).alias("u"), F.round(p["y"], 4).alias("v"))


@query("track_history", f"with {HISTORY} select channel_index, frame_index, track_id, seg, history, px, py, qx, qy from history")
def track_history(spark, d):
    return history(spark, d).select("channel_index", "frame_index", "track_id", "seg", "history", F.col("point.x").alias("px"), F.col("point.y").alias("py"), F.col("prev.x").alias("qx"), F.col("prev.y").alias("qy"))


@query("track_trail", f"with {HISTORY} select channel_index, track_id, seg, count(*) as points, min(frame_index) as first_frame, max(frame_index) as last_frame, round(sum(coalesce(sqrt((px - qx) ** 2 + (py - qy) ** 2), 0)), 4) as length from history group by 1, 2, 3")
def track_trail(spark, d):
    return T.trail_lengths(history(spark, d))


@query("track_trail_points", f"with {HISTORY} select channel_index, frame_index, track_id, array_to_string(list_transform(t, lambda p: p.x || ',' || p.y), ' ') as trail from (select *, list({{'x': px, 'y': py}}) over (partition by channel_index, track_id, seg order by frame_index rows between 4 preceding and current row) as t from history)")
def track_trail_points(spark, d):
    points = F.transform("trail", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string")))
    return T.track_trail(history(spark, d), 5).select("channel_index", "frame_index", "track_id", F.array_join(points, " ").alias("trail"))


@query("sort_track")
def sort_track(spark, d):
    rows = X.detections(spark, d).select("channel_index", "frame_index", F.col("track_id").cast("int").alias("target_no"), "x", "y", "width", "height")
    return T.sort_track_stretches(rows, X.tasks(spark, d)).select("channel_index", "frame_index", "target_no", "track_id")


@query("cross_line", f"with {CROSSINGS} select * from crossings")
def cross_line(spark, d):
    return _crossings(spark, d).drop("region")


@query("crossline_totals", f"with {CROSSINGS} select channel_index, frame_index, count(*) as crossings, (sum(count(*)) over (partition by channel_index order by frame_index))::bigint as total from crossings group by 1, 2")
def crossline_totals(spark, d):
    return B.crossline_totals(_crossings(spark, d))


@query("stop_hits", f"with {HISTORY} select channel_index, frame_index, track_id from history where ex is not null and {_ring_sql('px', 'py')} and sqrt((px - ex) ** 2 + (py - ey) ** 2) <= 5")
def stop_hits(spark, d):
    return B.stop_hits(history(spark, d), X.channel_config(spark)).select("channel_index", "frame_index", "track_id")


@query("stop_events", f"with {STOPS} select * from stop_events")
def stop_events(spark, d):
    return _stops(spark, d)


@query("stopped_now", f"with {STOPS}, counted as (select channel_index, frame_index, coalesce(sum(change) over w, 0)::bigint as stopped, coalesce(sum(new) over w, 0)::bigint as stops from frames left join (select channel_index, frame_index, sum(case ba_type when 2 then 1 else -1 end) as change, count(*) filter (ba_type = 2) as new from stop_events group by 1, 2) using (channel_index, frame_index) window w as (partition by channel_index order by frame_index)), spans as (select channel_index, track_id, frame_index as from_frame, to_frame from (select *, lead(frame_index) over (partition by channel_index, track_id order by frame_index) as to_frame from stop_events) where ba_type = 2) select channel_index, frame_index, stopped, stops, coalesce(ids, '') as ids from counted left join (select f.channel_index, f.frame_index, string_agg(track_id::varchar, ',' order by track_id) as ids from frames f join spans s on f.channel_index = s.channel_index and f.frame_index >= from_frame and f.frame_index < coalesce(to_frame, 2147483647) group by 1, 2) using (channel_index, frame_index)")
def stopped_now(spark, d):
    targets = X.detections(spark, d)
    frames = frames_once(targets)
    return B.stopped_now(_stops(spark, d, targets, frames), frames).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("stopped_ids", f"with {STOPS} select channel_index, track_id, frame_index as from_frame, to_frame from (select *, lead(frame_index) over (partition by channel_index, track_id order by frame_index) as to_frame from stop_events) where ba_type = 2")
def stopped_ids(spark, d):
    return B.stopped_ids(_stops(spark, d))


@query("jam_counts", "with " + JAMS.split("walk as (")[0].rstrip().rstrip(",") + " select channel_index, frame_index, stops from counts")
def jam_counts(spark, d):
    return _jam_counts(spark, d).select("channel_index", "frame_index", "stops")


@query("jam_events", f"with recursive {JAMS} select * from jam_events")
def jam_events(spark, d):
    return B.jam_events(_jam_counts(spark, d))


@query("jam_status", f"with recursive {JAMS} select channel_index, frame_index, coalesce(last_value(ba_type ignore nulls) over (partition by channel_index order by frame_index) = 8, false) as jammed from frames left join jam_events using (channel_index, frame_index)")
def jam_status(spark, d):
    targets = X.detections(spark, d)
    frames = frames_once(targets)
    return B.jam_status(B.jam_events(_jam_counts(spark, d, targets, frames)), frames)


@query("targets_by_ids", f"with {CROSSINGS} select d.channel_index, d.frame_index, d.track_id, d.x, d.y from detections d join crossings c using (channel_index, frame_index, track_id)")
def targets_by_ids(spark, d):
    events = _crossings(spark, d).withColumn("target_ids", F.array("track_id"))
    return B.targets_by_ids(X.detections(spark, d), events).select("channel_index", "frame_index", "track_id", "x", "y")


@query("track_flags", f"with {STOPS}, {CROSSINGS[len(HISTORY) + 1:]} select channel_index, track_id, bit_or(ba_type)::int as ba_flags from (select channel_index, track_id, ba_type from stop_events union all select channel_index, track_id, ba_type from crossings) group by 1, 2")
def track_flags(spark, d):
    parts = [e.select("channel_index", "track_id", "ba_type") for e in (_stops(spark, d), _crossings(spark, d))]
    return B.track_flags(parts[0].unionByName(parts[1]))


@query("state_changes", "select channel_index, event_id, was, event_type from (select user_id % 4 as channel_index, event_id, event_type, lag(event_type) over (partition by user_id % 4 order by event_id) as was from events) where was <> event_type")
def state_changes(spark, d):
    rows = X.read(spark, d, "events").selectExpr("user_id % 4 as channel_index", "event_id", "event_type")
    return B.state_changes(rows, ["channel_index"], "event_id", "event_type")
