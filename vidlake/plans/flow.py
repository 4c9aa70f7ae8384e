"""Queries of sources, flow between channels, recording and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vidlake import fixtures as X
from vidlake.functions.geometry import homography
from vidlake.operators import behaviour as B, flow as W, metrics as M, record as R
from vidlake.plans import behaviour as PB
from vidlake.sources import frames as S

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


FR = X.FRAMES_SQL


@query("read_frames", "select o_orderkey, o_custkey from orders")
def read_frames(spark, d):
    return S.read_frames(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey")


@query("number_frames", "select (user_id % 4)::int as channel_index, event_id, (row_number() over (partition by user_id % 4 order by ts, event_id) - 1)::int as frame_index from events")
def number_frames(spark, d):
    rows = X.read(spark, d, "events").selectExpr("cast(user_id % 4 as int) as channel_index", "event_id", "ts")
    return S.number_frames(rows, ["ts", "event_id"]).drop("ts")


@query("accepted_batches", """
    with r as (select o_orderkey, (o_orderkey % 4)::int as channel_index, o_orderkey // 100 as batch_no, (800 + (o_orderkey % 997 = 0)::int * 10 + (o_orderkey // 100 % 7 = 3)::int * 20)::int as width, 600 as height from orders),
    s as (select channel_index, batch_no, min(width) as w from r group by 1, 2 having min(width) = max(width)),
    f as (select channel_index, arg_min(w, batch_no) as first from s group by 1)
    select channel_index, batch_no, o_orderkey, width, height, 1 as fps from r join s using (channel_index, batch_no) join f using (channel_index) where w = first""")
def accepted_batches(spark, d):
    rows = X.read(spark, d, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 4 as int) as channel_index", "o_orderkey div 100 as batch_no", "cast(800 + cast(o_orderkey % 997 = 0 as int) * 10 + cast(o_orderkey div 100 % 7 = 3 as int) * 20 as int) as width", "600 as height")
    return S.accepted_batches(rows)


@query("sample_frames", f"with {FR} select channel_index, (frame_index // 3)::int as frame_index, 8 as fps, width, height from frames where frame_index % 3 = 2")
def sample_frames(spark, d):
    return S.sample_frames(X.frames(spark, d), 2)


@query("sample_every", f"with {FR} select channel_index, min(frame_index) as frame_index, 25 as fps from frames group by channel_index, frame_index // 50")
def sample_every(spark, d):
    return S.sample_every(S.frame_time(X.frames(spark, d)), 2).select("channel_index", "frame_index", "fps")


@query("resize_frames", f"with {FR} select channel_index, frame_index, fps, trunc(width * 0.6::double)::int as width, trunc(height * 0.6::double)::int as height from frames")
def resize_frames(spark, d):
    return S.resize(X.frames(spark, d), 0.6)


@query("resize_targets", f"with {FR} select channel_index, frame_index, track_id, trunc(x * 0.6::double)::int as x, trunc(y * 0.6::double)::int as y, trunc(width * 0.6::double)::int as width, trunc(height * 0.6::double)::int as height from detections")
def resize_targets(spark, d):
    return S.resize(X.detections(spark, d), 0.6, ("x", "y", "width", "height")).drop("primary_class_id")


@query("stream_info", f"with {FR} select channel_index, 25 as fps, 800 as width, 700 as height, count(*) as frames from frames group by 1")
def stream_info(spark, d):
    return S.stream_info(X.frames(spark, d))


@query("split_by_channel", f"with {FR} select channel_index, count(*) as n from frames group by 1")
def split_by_channel(spark, d):
    parts = W.split_by_channel(X.frames(spark, d), 4)
    return W.merge_streams(*[p.groupBy("channel_index").agg(F.count(F.lit(1)).alias("n")) for p in parts])


@query("fan_out", f"with {FR} select 'small' as branch, count(*) as n from detections where width < 40 union all select 'large', count(*) from detections where width >= 40")
def fan_out(spark, d):
    branch = lambda name, where: lambda df: df.where(where).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("branch"), "n")
    return W.merge_streams(*W.fan_out(X.detections(spark, d), [branch("small", "width < 40"), branch("large", "width >= 40")]))


@query("merge_streams", f"with {FR} select channel_index, frame_index from frames")
def merge_streams(spark, d):
    parts = W.split_by_channel(X.frames(spark, d).select("channel_index", "frame_index"), 4)
    return W.merge_streams(*parts)


def _branch(spark, d, where, mask):
    rows = X.detections(spark, d).where(where).groupBy("channel_index", "frame_index").agg(F.sort_array(F.collect_list("track_id")).alias("targets"))
    return rows.withColumn("mask", F.when(F.col("frame_index") % 3 == mask, F.concat(F.lit("m"), F.lit(mask))))


_BRANCH = "{name} as (select channel_index, frame_index, list(track_id order by track_id) as targets, case when frame_index % 3 = {k} then 'm{k}' end as mask from detections where {where} group by 1, 2)"


@query("sync_merge", f"with {FR}, {_BRANCH.format(name='a', k=0, where='primary_class_id < 3')}, {_BRANCH.format(name='b', k=1, where='primary_class_id > 2 and frame_index % 5 > 0')} select channel_index, frame_index, array_to_string(list_concat(coalesce(a.targets, []), coalesce(b.targets, [])), ',') as targets, coalesce(a.mask, b.mask) as mask from a full join b using (channel_index, frame_index)")
def sync_merge(spark, d):
    out = W.sync_merge(_branch(spark, d, "primary_class_id < 3", 0), _branch(spark, d, "primary_class_id > 2 and frame_index % 5 > 0", 1))
    return out.withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


_NUMBERED = "{name} as (select channel_index, frame_index, (row_number() over (partition by channel_index, frame_index order by track_id) - 1)::int as target_no, {id} as track_id, ['{name}' || primary_class_id] as secondary, case when {has} then [track_id::double] else [] end as embedding from detections where {where})"


@query("sync_update", f"with {FR}, {_NUMBERED.format(name='a', id='case when track_id % 3 = 0 then -1 else track_id end', has='track_id % 2 = 0', where='true')}, {_NUMBERED.format(name='b', id='track_id', has='true', where='frame_index % 4 > 0 or track_id % 100 > 0')}, same as (select channel_index, frame_index from (select channel_index, frame_index, count(*) as n from a group by 1, 2) join (select channel_index, frame_index, count(*) as m from b group by 1, 2) using (channel_index, frame_index) where n = m) select channel_index, frame_index, target_no, case when a.track_id = -1 then coalesce(b.track_id, -1) else a.track_id end as track_id, array_to_string(list_concat(a.secondary, coalesce(b.secondary, [])), '|') as secondary, (case when len(a.embedding) = 0 and b.embedding is not null then b.embedding else a.embedding end)[1] as embedding from a left join (select b.* from b semi join same using (channel_index, frame_index)) b using (channel_index, frame_index, target_no)")
def sync_update(spark, d):
    from pyspark.sql import Window

    no = (F.row_number().over(Window.partitionBy("frame_index", "channel_index").orderBy("track_id")) - 1).cast("int")

    def branch(name, own, has, where):
        rows = X.detections_by_frame(spark, d).where(where).withColumn("target_no", no)
        return rows.select("channel_index", "frame_index", "target_no", own.alias("track_id"), F.array(F.concat(F.lit(name), F.col("primary_class_id").cast("string"))).alias("secondary"), F.when(has, F.array(F.col("track_id").cast("double"))).otherwise(F.array().cast("array<double>")).alias("embedding"))

    t = F.col("track_id")
    a = branch("a", F.when(t % 3 == 0, F.lit(-1)).otherwise(t), t % 2 == 0, "true")
    b = branch("b", t, F.lit(True), "frame_index % 4 > 0 or track_id % 100 > 0")
    return W.sync_update(a, b).withColumns({"secondary": F.array_join("secondary", "|"), "embedding": F.get("embedding", 0)})


@query("sync_timeouts", f"with {FR}, a as (select * from frames where frame_index % 7 > 0), b as (select * from frames where frame_index % 5 > 0), ab as (select channel_index, frame_index, a.fps is null or b.fps is null as alone from a full join b using (channel_index, frame_index)) select channel_index, frame_index, alone, alone and (max(frame_index) over (partition by channel_index) - frame_index) * 40 >= 160 as timed_out from ab")
def sync_timeouts(spark, d):
    f = X.frames(spark, d)
    return W.sync_timeouts(f.where("frame_index % 7 > 0"), f.where("frame_index % 5 > 0"), 160)


_CONTROLS = "controls as (select event_id, (user_id % 4)::int as channel_index, ts, 'vp_control_' || (event_id // 20) as control_uid from events)"


@query("dedupe_controls", f"with {_CONTROLS} select channel_index, event_id, control_uid from (select *, lag(control_uid) over (partition by channel_index order by ts, event_id) as b from controls) where b is null or b <> control_uid")
def dedupe_controls(spark, d):
    rows = X.read(spark, d, "events").selectExpr("event_id", "cast(user_id % 4 as int) as channel_index", "ts", "concat('vp_control_', cast(event_id div 20 as string)) as control_uid")
    return W.dedupe_controls(rows, ["ts", "event_id"]).drop("ts")


_ARRIVALS = "arrivals as (select (user_id % 4)::int as channel_index, event_id as frame_index, ts as create_time, user_id // 4 % 16 as pair from events)"
_PAIRS = _ARRIVALS + ", pairs as (select pair, frame_index as src_frame, dst_frame from (select *, lag(channel_index) over w as was, lag(frame_index) over w as dst_frame from arrivals where channel_index in (0, 1) window w as (partition by pair order by create_time, channel_index, frame_index)) where channel_index = 0 and was = 1)"


def _arrivals(spark, d):
    return X.read(spark, d, "events").selectExpr("cast(user_id % 4 as int) as channel_index", "event_id as frame_index", "ts as create_time", "user_id div 4 % 16 as pair")


@query("pair_channels", f"with {_PAIRS} select * from pairs")
def pair_channels(spark, d):
    return W.pair_channels(_arrivals(spark, d), 0, 1, ["pair"])


_H = homography([(0, 0), (800, 0), (800, 700), (0, 700)], [(30, 10), (790, 40), (760, 690), (20, 650)])
_P = lambda x, y, k: f"round(({_H[k]!r} * ({x}) + {_H[k + 1]!r} * ({y}) + {_H[k + 2]!r}) / ({_H[6]!r} * ({x}) + {_H[7]!r} * ({y}) + 1.0), 4)"


@query("project_targets", f"with {FR}, {_PAIRS}, t as (select track_id, frame_index as src_frame, x::double as x, y::double as y, width, height from detections where channel_index = 0) select track_id, src_frame::bigint as src_frame, dst_frame, {_P('x', 'y', 0)} as \"left\", {_P('x', 'y', 3)} as top, {_P('x + width', 'y + height', 0)} as \"right\", {_P('x + width', 'y + height', 3)} as bottom from t join pairs using (src_frame)")
def project_targets(spark, d):
    pairs = W.pair_channels(_arrivals(spark, d), 0, 1, ["pair"]).drop("pair")
    return W.project_targets(pairs, X.detections(spark, d), 0, _H)


# ---- recording ----

_ASKED = "asked as (select row_number() over (order by channel_index, frame_index) as clip_id, channel_index, frame_index, (case when frame_index % 2 = 0 then 0 else 10 end)::int as duration from (select distinct channel_index, frame_index from frames where frame_index % 400 = 130))"
_FORD = "ford as (select channel_index, frame_index, row_number() over (partition by channel_index order by frame_index) as ford from frames)"
_CLIPS = f"{_ASKED}, {_FORD}, ranges as (select clip_id, channel_index, greatest(1, ford - 125) as s, (5 + case when duration > 0 then duration else 20 end) * 25 as len from asked join ford using (channel_index, frame_index)), clips as (select clip_id, f.channel_index, f.frame_index, (f.ford - s + 1)::int as n, len from ranges r join ford f on f.channel_index = r.channel_index and f.ford between s and s + len - 1)"


def _asked(spark, d):
    from pyspark.sql import Window

    rows = X.frames(spark, d).where("frame_index % 400 = 130").select("channel_index", "frame_index").distinct()
    # requests are few; numbered in order for the check
    return rows.withColumn("clip_id", F.row_number().over(Window.orderBy("channel_index", "frame_index")).cast("long")).withColumn("duration", F.when(F.col("frame_index") % 2 == 0, 0).otherwise(10))


@query("select_clips", f"with {FR}, {_CLIPS} select clip_id, channel_index, frame_index, n from clips")
def select_clips(spark, d):
    return R.select_clips(X.frames(spark, d), _asked(spark, d))


@query("select_snapshots", f"with {FR}, {_ASKED} select clip_id, channel_index, frame_index from asked")
def select_snapshots(spark, d):
    return R.select_snapshots(X.frames(spark, d), _asked(spark, d))


@query("record_info", f"with {FR}, {_CLIPS} select clip_id, channel_index, count(*) as frames, min(frame_index) as first_frame, max(frame_index) as last_frame, count(*) = any_value(len) as complete from clips group by 1, 2")
def record_info(spark, d):
    asked = _asked(spark, d)
    return R.record_info(R.select_clips(X.frames(spark, d), asked), asked, X.FPS)


_STAMP = "strftime(timestamp '2024-01-01 00:00:00' + to_milliseconds(frame_index::bigint * 40), '%Y%m%d%H%M%S%g')"


def _stop_frames(spark, d):
    events = PB.QUERIES["stop_events"](spark, d).withColumn("fps", F.lit(X.FPS)).withColumn("kind", F.col("ba_label"))
    return S.frame_time(events)


@query("controls_from_events", f"with {PB.STOPS}, named as (select *, {_STAMP} as stamp from stop_events) select channel_index, frame_index, 'image_record' as control_type, ba_label || '_image__' || stamp as file_name, 0 as duration, true as osd from named union all select channel_index, frame_index, 'video_record', ba_label || '_video__' || stamp, 0, false from named")
def controls_from_events(spark, d):
    return R.controls_from_events(_stop_frames(spark, d))


@query("manual_controls", "select event_id, (event_id % 90)::int as duration from events where event_type = 'purchase' and event_id % 90 between 5 and 60")
def manual_controls(spark, d):
    return R.manual_controls(X.read(spark, d, "events").where("event_type = 'purchase'").selectExpr("event_id", "cast(event_id % 90 as int) as duration"))


@query("record_path", f"with {PB.STOPS}, named as (select channel_index, frame_index, track_id as clip_id, 'videos/' || strftime(timestamp '2024-01-01 00:00:00' + to_milliseconds(frame_index::bigint * 40), '%Y-%m-%d') || '/' || channel_index || '/' || ba_label as stem from stop_events) select channel_index, frame_index, clip_id, stem || case when nth > 1 then '_' || nth else '' end || '.mp4' as path from (select *, row_number() over (partition by stem order by frame_index, clip_id) as nth from named)")
def record_path(spark, d):
    rows = _stop_frames(spark, d).select("channel_index", "frame_index", "frame_ts", F.col("track_id").alias("clip_id"), F.col("ba_label").alias("file_name"), F.lit("video_record").alias("control_type"))
    return R.record_path(rows, "videos").select("channel_index", "frame_index", "clip_id", "path")


@query("file_segments", f"with {FR}, {_FORD} select channel_index, frame_index, ((ford - 1) // 1500)::int as segment from ford")
def file_segments(spark, d):
    return R.file_segments(X.frames(spark, d), 1)


# ---- metrics ----

TR = X.TRACE_SQL
_CELL = lambda ms: f"(epoch_us(in_time) // {ms * 1000}) * {ms}"
_MS = "((epoch_us(out_time) - epoch_us(in_time)) / 1000)"


@query("output_fps", f"with {TR} select channel_index, {_CELL(500)} as epoch_ms, count(*) * 1000 / 500 as fps from trace group by 1, 2")
def output_fps(spark, d):
    return M.output_fps(X.trace(spark, d))


@query("latency", f"with {TR} select channel_index, {_CELL(3600000)} as epoch_ms, round(avg({_MS}), 6) as avg_ms, round(quantile_cont({_MS}, 0.95), 6) as p95_ms, max({_MS}) as max_ms from trace group by 1, 2")
def latency(spark, d):
    return M.latency(X.trace(spark, d))


@query("stream_status", f"with {TR} select channel_index, node, arg_max(frame_index, (in_time, event_id)) as frame_index, arg_max({_MS}, (in_time, event_id)) as latency_ms, count(*) as frames, case when max(in_time) > min(in_time) then round((count(*) - 1) / ((epoch_us(max(in_time)) - epoch_us(min(in_time))) / 1000 / 1000), 6) end as fps from trace group by 1, 2")
def stream_status(spark, d):
    return M.stream_status(X.trace(spark, d))


@query("node_throughput", f"with {TR} select node, port, {_CELL(3600000)} as epoch_ms, count(*) as events from trace group by 1, 2, 3")
def node_throughput(spark, d):
    return M.node_throughput(X.trace(spark, d))


@query("queue_depth", f"with {TR} select node, epoch_ms, (sum(change) over (partition by node order by epoch_ms))::bigint as depth from (select node, {_CELL(3600000)} as epoch_ms, sum(case port when 'in' then 1 else -1 end) as change from trace group by 1, 2)")
def queue_depth(spark, d):
    return M.queue_depth(X.trace(spark, d))


@query("hop_time", f"with {TR} select channel_index, node, event_id, {_MS} as in_node_ms, (epoch_us(in_time) - epoch_us(lag(out_time) over (partition by channel_index, node order by in_time, event_id))) / 1000 as gap_ms from trace")
def hop_time(spark, d):
    return M.hop_time(X.trace(spark, d))


@query("threshold_alerts", "select channel, event_id, value from (select user_id % 4 as channel, event_id, value, lag(value) over (partition by user_id % 4 order by event_id) as was from events) where value > 50 and (was is null or was <= 50)")
def threshold_alerts(spark, d):
    rows = X.read(spark, d, "events").selectExpr("user_id % 4 as channel", "event_id", "value")
    return M.threshold_alerts(rows, ["channel"], "event_id", "value", 50.0)


#: Seconds after which a port of this table, whose events are half an hour apart, is stale.
_STALE = 3600


@query("stale_ports", f"""
    with {TR},
    s as (select node, port, in_time, coalesce((epoch_us(in_time) - epoch_us(lag(in_time) over w) >= {_STALE * 1_000_000})::int, 1) as fresh from trace window w as (partition by node, port order by in_time)),
    n as (select *, sum(fresh) over (partition by node, port order by in_time rows unbounded preceding) as stretch from s),
    a as (select node, port, stretch, min(in_time) as active_from, max(in_time) + interval {_STALE} second as stale_from, count(*) as events from n group by 1, 2, 3)
    select node, port, active_from, stale_from, lead(active_from) over (partition by node, port order by active_from) as active_again, events from a""")
def stale_ports(spark, d):
    return M.stale_ports(X.trace(spark, d), _STALE)


@query("latency_rollup", f"""
    with {TR},
    r as (select channel_index, {_CELL(86_400_000)} as epoch_ms, {_MS} as ms from trace),
    b as (select *, case when ms >= 0.001 then ceil(ln(ms) / ln(1.01::double / 0.99::double))::int end as bin from r),
    h as (select channel_index, epoch_ms, bin, count(*) as n, sum(ms) as total, max(ms) as top from b group by 1, 2, 3),
    p as (select *, sum(n) over (partition by channel_index, epoch_ms order by bin nulls first) as below, sum(n) over (partition by channel_index, epoch_ms) as whole from h)
    select channel_index, epoch_ms, round(sum(total) / sum(n), 6) as avg_ms, round(min(case when below >= ceil(whole * 0.95::double) then coalesce(pow(1.01::double / 0.99::double, bin) * 0.99, 0) end), 6) as p95_ms, max(top) as max_ms from p group by 1, 2""")
def latency_rollup(spark, d):
    # sketches an hour, added up to days
    days = M.sketch_latency(M.rolled_up(M.latency_sketch(X.trace(spark, d)), 86_400_000))
    return days.withColumn("p95_ms", F.round("p95_ms", 6))


@query("source_info", """
    with f as (select (o_orderkey % 4)::int as channel_index, o_orderkey // 4 as frame_index, (25 + o_orderkey // 4 // 500 % 2 * 5)::int as fps, 800 as width, 700 as height, 'rtsp://camera/' || (o_orderkey % 4) || '/' || (o_orderkey // 4 // 700) as uri from orders),
    w as (select *, lag(fps) over o as was_fps, lag(uri) over o as was_uri from f window o as (partition by channel_index order by frame_index))
    select channel_index, fps as original_fps, width as original_width, height as original_height, uri, frame_index as since_frame from w where was_uri is null or was_fps <> fps or was_uri <> uri""")
def source_info(spark, d):
    rows = X.read(spark, d, "orders").selectExpr("cast(o_orderkey % 4 as int) as channel_index", "o_orderkey div 4 as frame_index", "cast(25 + o_orderkey div 4 div 500 % 2 * 5 as int) as fps", "800 as width", "700 as height", "concat('rtsp://camera/', o_orderkey % 4, '/', o_orderkey div 4 div 700) as uri")
    return S.source_info(rows)
