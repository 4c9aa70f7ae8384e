"""Queries of decoding, attached results, equations, messages and models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window, functions as F

from vidlake import fixtures as X
from vidlake.functions import text as TX
from vidlake.operators import decode as D, equations as E, messages as G, models as U, track as T
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


RAW = X.RAW_ROWS_SQL
_at = lambda k, of, size: f"trunc((case when v[{k}] <= 1 then v[{k}] else v[{k}] / {of} end) * {size})::int"
YOLO = RAW + f""",
    placed as (
        select channel_index, frame_index, head, row_no, {_at(1, 416, 800)} as cx, {_at(2, 416, 700)} as cy, {_at(3, 416, 800)} as width, {_at(4, 416, 700)} as height,
            (list_position(v[6:], list_max(v[6:])) - 1)::int as primary_class_id, v[5] as primary_score
        from raw_rows where v[5] >= 0.3 and list_max(v[6:]) >= 0.3),
    yolo as (select channel_index, frame_index, head, row_no, (cx - width // 2)::int as x, (cy - height // 2)::int as y, width, height, primary_class_id, primary_score from placed)"""


def raw_frames(spark, d):
    return X.raw_rows(spark, d).select("channel_index", "frame_index").distinct().selectExpr("*", "800 as width", "700 as height")


def yolo(spark, d):
    return D.decode_yolo(X.raw_rows(spark, d), raw_frames(spark, d), 0.3, 0.3)


def numbered(spark, d):
    no = (F.row_number().over(Window.partitionBy("channel_index", "frame_index").orderBy("row_no", "head", "x", "y", "width", "height", "primary_class_id", "primary_score")) - 1).cast("int")
    return yolo(spark, d).withColumn("target_no", no)


NUMBERED = YOLO + ", numbered as (select *, (row_number() over (partition by channel_index, frame_index order by row_no, head, x, y, width, height, primary_class_id, primary_score) - 1)::int as target_no from yolo)"


@query("decode_yolo", f"with {YOLO} select * from yolo")
def decode_yolo(spark, d):
    return yolo(spark, d)


@query("decode_ssd", """
    with r as (select (l_orderkey % 4)::int as channel_index, (l_orderkey // 4)::int as frame_index, l_linenumber as row_no, (l_suppkey % 5)::int as k, l_discount * 10 as s,
        (l_partkey % 90) / 100.0::double as l, (l_suppkey % 80) / 100.0::double as t, (l_partkey % 90 + l_quantity) / 100 as r, (l_suppkey % 80 + l_quantity) / 90 as b from lineitem),
    e as (select *, greatest(0, least(trunc(l * 800)::int, 799)) as l2, greatest(0, least(trunc(t * 700)::int, 699)) as t2, greatest(0, least(trunc(r * 800)::int, 799)) as r2, greatest(0, least(trunc(b * 700)::int, 699)) as b2 from r where s > 0.5)
    select channel_index, frame_index, row_no, l2 as x, t2 as y, r2 - l2 as width, b2 - t2 as height, k as primary_class_id, s as primary_score from e""")
def decode_ssd(spark, d):
    raw = X.read(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey % 4 as int) as channel_index", "cast(l_orderkey div 4 as int) as frame_index", "l_linenumber as row_no",
        "array(0D, cast(l_suppkey % 5 as double), l_discount * 10, (l_partkey % 90) / 100D, (l_suppkey % 80) / 100D, (l_partkey % 90 + l_quantity) / 100, (l_suppkey % 80 + l_quantity) / 90) as values",
    )
    return D.decode_ssd(raw, raw_frames(spark, d))


_FACE_ROWS = """
    rows as (
        select (l_orderkey % 4)::int as channel_index, (l_orderkey // 4)::int as frame_index, ((l_partkey * 7 + l_suppkey) % 4385)::int as row_no,
            list_transform(generate_series(1, 14), lambda k: ((l_partkey + k * 13) % 21 - 10) / 10.0::double) as loc, l_discount * 10 as cls, 0.4::double + l_tax * 10 as iou_score
        from lineitem)"""
_PRIORS = " union all ".join(
    f"select {k} as map, i, j, size, (j + 0.5) * {step} / 320::double as cx, (i + 0.5) * {step} / 320::double as cy, size / 320::double as sx, size / 320::double as sy"
    f" from (select unnest(generate_series(0, {n - 1})) as i), (select unnest(generate_series(0, {n - 1})) as j), (select unnest({list(sizes)}) as size)"
    for k, (step, sizes, n) in enumerate(zip(D.FACE_STEPS, D.FACE_SIZES, (40, 20, 10, 5)))
)


@query("decode_face", f"""
    with {_FACE_ROWS},
    priors as (select *, row_number() over (order by map, i, j, size) - 1 as row_no from ({_PRIORS})),
    scored as (select *, sqrt(cls * greatest(0, least(1, iou_score))) as s, cx + loc[1] * 0.1::double * sx as fx, cy + loc[2] * 0.1::double * sy as fy, sx * exp(loc[3] * 0.1::double) as fw, sy * exp(loc[4] * 0.2::double) as fh from rows join priors using (row_no))
    select channel_index, frame_index, row_no, trunc((fx - fw / 2) * 320)::int as x, trunc((fy - fh / 2) * 320)::int as y, trunc(fw * 320)::int as box_width, trunc(fh * 320)::int as box_height, round(s, 6) as score,
        array_to_string(list_transform([0, 1, 2, 3, 4], lambda k: trunc((cx + loc[5 + 2 * k] * 0.1::double * sx) * 320)::int || ',' || trunc((cy + loc[6 + 2 * k] * 0.1::double * sy) * 320)::int), ' ') as points
    from scored where s > 0.7""")
def decode_face(spark, d):
    rows = X.read(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey % 4 as int) as channel_index", "cast(l_orderkey div 4 as int) as frame_index", "cast((l_partkey * 7 + l_suppkey) % 4385 as int) as row_no",
        "transform(sequence(1, 14), k -> ((l_partkey + k * 13) % 21 - 10) / 10D) as loc", "l_discount * 10 as cls", "0.4D + l_tax * 10 as iou_score",
    )
    frames = rows.select("channel_index", "frame_index").distinct().selectExpr("*", "320 as width", "320 as height")
    points = F.array_join(F.transform("key_points", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return D.decode_face(rows, frames).withColumn("points", points).drop("key_points")


_INTER = "(greatest(0, least(k.x + k.w, f.x + f.width) - greatest(k.x, f.x)) * greatest(0, least(k.y + k.h, f.y + f.height) - greatest(k.y, f.y)))"
_NMS = YOLO + f""",
    few as (select *, row_number() over (partition by channel_index, frame_index order by primary_score desc, row_no, x, y, width, height, primary_class_id) as place from yolo where width > 0 and height > 0),
    walk as (
        select channel_index, frame_index, 0::bigint as place, [] ::struct(x int, y int, w int, h int)[] as kept, -1 as row_no, false as taken from (select distinct channel_index, frame_index from few)
        union all
        select channel_index, frame_index, place, case when ok then list_append(kept, {{'x': x, 'y': y, 'w': width, 'h': height}}) else kept end, row_no, ok
        from (select f.*, w.kept, len(list_filter(w.kept, lambda k: {_INTER}::double / (k.w * k.h + f.width * f.height - {_INTER}) > 0.3)) = 0 as ok
            from walk w join few f on f.channel_index = w.channel_index and f.frame_index = w.frame_index and f.place = w.place + 1))"""


@query("nms", f"with recursive {_NMS} select channel_index, frame_index, row_no from walk where taken")
def nms(spark, d):
    return D.nms(yolo(spark, d).where("width > 0 and height > 0"), 0.3).select("channel_index", "frame_index", "row_no")


@query("clip_boxes", f"with {YOLO} select channel_index, frame_index, head, row_no, x, y, least(width, 800 - x) as width, least(height, 700 - y) as height from (select channel_index, frame_index, head, row_no, greatest(x, 0) as x, greatest(y, 0) as y, width, height from yolo) where least(width, 800 - x) > 0 and least(height, 700 - y) > 0")
def clip_boxes(spark, d):
    return D.clip_boxes(yolo(spark, d), raw_frames(spark, d)).drop("primary_class_id", "primary_score")


_LABELS = "labels_of as (select (p_partkey)::int as primary_class_id, p_brand as primary_label from part)"


@query("label_lookup", f"with {YOLO}, {_LABELS} select channel_index, frame_index, head, row_no, primary_class_id, coalesce(primary_label, '') as primary_label from yolo left join labels_of using (primary_class_id)")
def label_lookup(spark, d):
    labels = X.read(spark, d, "part").selectExpr("cast(p_partkey as int) as class_id", "concat(p_brand, '\\r') as label")
    return D.label_lookup(yolo(spark, d), labels).select("channel_index", "frame_index", "head", "row_no", "primary_class_id", "primary_label")


@query("merge_detectors", f"with {NUMBERED} select channel_index, frame_index, row_no, (primary_class_id + case when head = 0 then 0 else 100 end)::int as primary_class_id, (row_number() over (partition by channel_index, frame_index order by head > 0, target_no) - 1)::int as target_no from numbered")
def merge_detectors(spark, d):
    rows = numbered(spark, d)
    out = D.merge_detectors([(rows.where("head = 0"), 0), (rows.where("head > 0"), 100)])
    return out.select("channel_index", "frame_index", "row_no", "primary_class_id", "target_no")


@query("gate_targets", f"with {YOLO} select channel_index, frame_index, head, row_no from yolo where width >= 60 and height >= 50 and primary_class_id in (1, 2)")
def gate_targets(spark, d):
    return D.gate_targets(yolo(spark, d), [1, 2], 60, 50).select("channel_index", "frame_index", "head", "row_no")


@query("crop_boxes", f"with {YOLO}, c as (select channel_index, frame_index, head, row_no, greatest(x - 10, 0) as x, greatest(y - 10, 0) as y, width + 20 as w, height + 20 as h from yolo) select channel_index, frame_index, head, row_no, x, y, least(w, 800 - x) as width, least(h, 700 - y) as height from c")
def crop_boxes(spark, d):
    return D.crop_boxes(yolo(spark, d), 800, 700).drop("primary_class_id", "primary_score")


def _scores(spark, d):
    return X.vectors(spark, d).withColumn("scores", F.slice("embedding", 1, 5))


@query("classify", f"with {X.VECTORS_SQL}, s as (select vec_id, embedding[1:5] as s from vectors) select vec_id, (list_position(s, list_max(s)) - 1)::int as class_id, round(1 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) as class_score, coalesce(['a', 'b', 'c', 'd'][list_position(s, list_max(s))], '') as class_label from s")
def classify(spark, d):
    return D.classify(_scores(spark, d), ["a", "b", "c", "d"]).select("vec_id", "class_id", "class_score", "class_label")


_BOTH = NUMBERED + ", n as (select channel_index, frame_index, target_no, row_no from numbered), vec as (select (vec_id % 4)::int as channel_index, (vec_id // 4 // 2)::int as frame_index, (vec_id // 4 % 2)::int as target_no, label, embedding from embeddings)"


def _vecs(spark, d):
    return X.read(spark, d, "embeddings").selectExpr("cast(vec_id % 4 as int) as channel_index", "cast(vec_id div 4 div 2 as int) as frame_index", "cast(vec_id div 4 % 2 as int) as target_no", "label", "cast(embedding as array<double>) as embedding")


@query("attach_embeddings", f"with {_BOTH} select channel_index, frame_index, target_no, round(embedding[1]::double, 6) as first, len(embedding)::int as size from n left join vec using (channel_index, frame_index, target_no)")
def attach_embeddings(spark, d):
    out = D.attach(numbered(spark, d), _vecs(spark, d), "embedding")
    return out.select("channel_index", "frame_index", "target_no", F.round(F.get("embedding", 0), 6).alias("first"), F.size("embedding").alias("size"))


@query("attach_secondary", f"with {_BOTH} select channel_index, frame_index, target_no, coalesce('c' || label || '|d' || label, '') as secondary from n left join vec using (channel_index, frame_index, target_no)")
def attach_secondary(spark, d):
    v = _vecs(spark, d)
    classes = v.selectExpr("channel_index", "frame_index", "target_no", "0 as class_id", "concat('c', label) as class_label").unionByName(v.selectExpr("channel_index", "frame_index", "target_no", "1 as class_id", "concat('d', label) as class_label"))
    return D.attach_secondary(numbered(spark, d), classes).select("channel_index", "frame_index", "target_no", F.array_join("secondary", "|").alias("secondary"))


_PLATES = """
    plates as (
        select (o_orderkey % 4)::int as channel_index, (o_orderkey // 8)::int as frame_index, (o_orderkey // 4 % 2)::int as target_no, (o_custkey % 900 - 20)::int as x, (o_orderkey % 710 - 5)::int as y,
            (o_custkey % 60)::int as width, 20 as height, ['blue', 'green', 'yellow'][(o_custkey % 3 + 1)::int] as color, case when o_orderkey % 9 = 0 then '' else 'A' || (100000 + o_custkey % 50000) end as text
        from orders)"""


def _plates(spark, d):
    return X.read(spark, d, "orders").selectExpr(
        "cast(o_orderkey % 4 as int) as channel_index", "cast(o_orderkey div 8 as int) as frame_index", "cast(o_orderkey div 4 % 2 as int) as target_no", "cast(o_custkey % 900 - 20 as int) as x", "cast(o_orderkey % 710 - 5 as int) as y",
        "cast(o_custkey % 60 as int) as width", "20 as height", "array('blue', 'green', 'yellow')[o_custkey % 3] as color", "case when o_orderkey % 9 = 0 then '' else concat('A', cast(100000 + o_custkey % 50000 as string)) end as text",
    )


@query("attach_subtargets", f"with {NUMBERED}, {_PLATES}, p as (select n.channel_index, n.frame_index, n.target_no, greatest(0, p.x + n.x - 10) as x, greatest(0, p.y + n.y - 8) as y, p.width as w, p.height as h, color || '_' || text as label from numbered n join plates p using (channel_index, frame_index, target_no) where text <> '') select channel_index, frame_index, target_no, x, y, least(w, 800 - x) as width, least(h, 700 - y) as height, -1 as class_id, 0.0::double as score, label from p where least(w, 800 - x) > 0 and least(h, 700 - y) > 0")
def attach_subtargets(spark, d):
    return D.attach_subtargets(numbered(spark, d), _plates(spark, d), 800, 700)


@query("plate_targets", f"with {_PLATES}, p as (select channel_index, frame_index, greatest(0, x) as x, greatest(0, y) as y, width as w, height as h, color || '_' || text as label from plates where text <> '') select channel_index, frame_index, x, y, least(w, 800 - x) as width, least(h, 700 - y) as height, -1 as class_id, 0.0::double as score, label from p where least(w, 800 - x) > 0 and least(h, 700 - y) > 0")
def plate_targets(spark, d):
    return D.plate_targets(_plates(spark, d), 800, 700)


@query("text_targets", f"with {_PLATES} select channel_index, frame_index, target_no, x || ',' || y || ' ' || x + width || ',' || y || ' ' || x + width || ',' || y + height || ' ' || x || ',' || y + height as region, text, 0.5::double as score from plates")
def text_targets(spark, d):
    rows = _plates(spark, d).selectExpr("channel_index", "frame_index", "target_no", "x as x1", "y as y1", "x + width as x2", "y as y2", "x + width as x3", "y + height as y3", "x as x4", "y + height as y4", "text", "0.5D as score")
    return D.text_targets(rows).withColumn("region", F.array_join(F.transform("region", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " "))


@query("pose_from_vector", "select vec_id, unnest(generate_series(0, 16))::int as point_type, trunc(embedding[unnest(generate_series(0, 16)) * 3 + 1]::double * 100)::int as x, trunc(embedding[unnest(generate_series(0, 16)) * 3 + 2]::double * 100)::int as y from embeddings")
def pose_from_vector(spark, d):
    rows = X.vectors(spark, d).select("vec_id", F.transform(F.slice("embedding", 1, 51), lambda x: x * 100).alias("values"))
    return D.pose_from_vector(rows).select("vec_id", F.explode("key_points").alias("p")).select("vec_id", "p.point_type", "p.x", "p.y")


_CANDIDATES = """
    candidates as (
        select (l_orderkey % 4)::int as channel_index, (l_orderkey // 16)::int as frame_index, (l_suppkey % 3)::int as limb, (l_linenumber % 3)::int as a_id, (l_partkey % 1000)::int as b_id,
            list_transform(generate_series(1, 10), lambda k: ((l_partkey * k) % 17) / 20.0::double) as samples
        from lineitem),
    pairs as (
        select channel_index, frame_index, limb, a_id, b_id, round(list_sum(samples) / 10, 6) as score
        from (select *, row_number() over (partition by channel_index, frame_index, limb, a_id order by list_sum(samples) / 10 desc, b_id) as place
            from (select distinct * from candidates) where len(list_filter(samples, lambda s: s > 0.1)) > 7)
        where place = 1)"""


def _candidates(spark, d):
    return X.read(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey % 4 as int) as channel_index", "cast(l_orderkey div 16 as int) as frame_index", "cast(l_suppkey % 3 as int) as limb", "cast(l_linenumber % 3 as int) as a_id", "cast(l_partkey % 1000 as int) as b_id",
        "transform(sequence(1, 10), k -> ((l_partkey * k) % 17) / 20D) as samples",
    )


@query("limb_pairs", f"with {_CANDIDATES} select * from pairs")
def limb_pairs(spark, d):
    return D.limb_pairs(_candidates(spark, d))


_POSES = _CANDIDATES + """,
    turns as (select *, row_number() over (partition by channel_index, frame_index order by limb, a_id) as n from pairs),
    walk as (
        select channel_index, frame_index, 0::bigint as n, [] ::int[][] as persons from (select distinct channel_index, frame_index from turns)
        union all
        select t.channel_index, t.frame_index, t.n, case when holder > 0
                then list_transform(persons, lambda p, i: case when i = holder then list_transform(p, lambda v, k: case when k = limb + 2 then b_id else v end) else p end)
                else list_append(persons, list_transform([1, 2, 3, 4], lambda k: case when k = limb + 1 then a_id when k = limb + 2 then b_id else -1 end)) end
        from (select t.*, w.persons, coalesce(list_position(list_transform(w.persons, lambda p: p[t.limb + 1]), t.a_id), 0) as holder
            from walk w join turns t on t.channel_index = w.channel_index and t.frame_index = w.frame_index and t.n = w.n + 1) t),
    last as (select * from walk qualify row_number() over (partition by channel_index, frame_index order by n desc) = 1)"""


@query("assemble_poses", f"with recursive {_POSES} select channel_index, frame_index, (unnest(generate_series(1, len(persons))) - 1)::int as person, array_to_string(unnest(persons), ',') as joints from last")
def assemble_poses(spark, d):
    poses = D.assemble_poses(D.limb_pairs(_candidates(spark, d)).drop("score"), [(0, 1), (1, 2), (2, 3)], 4)
    return poses.withColumn("joints", F.array_join(F.col("joints").cast("array<string>"), ","))


def _cells(spark, d):
    return X.vectors(spark, d).select("channel_index", F.floor(F.col("frame_index") / 50).cast("int").alias("frame_index"), F.col("vec_id").alias("cell"), F.slice("embedding", 1, 4).alias("scores"), F.get("embedding", 5).alias("score"))


@query("mask_argmax", f"with {X.VECTORS_SQL} select channel_index, vec_id as cell, (list_position(embedding[1:4], list_max(embedding[1:4])) - 1)::int as class_id from vectors")
def mask_argmax(spark, d):
    return D.mask_argmax(_cells(spark, d)).select("channel_index", "cell", "class_id")


@query("mask_coverage", f"with {X.VECTORS_SQL} select channel_index, (frame_index // 50)::int as frame_index, (list_position(embedding[1:4], list_max(embedding[1:4])) - 1)::int as class_id, count(*) as cells from vectors group by 1, 2, 3")
def mask_coverage(spark, d):
    return D.mask_coverage(_cells(spark, d))


@query("mask_binary", f"with {X.VECTORS_SQL} select channel_index, (frame_index // 50)::int as frame_index, count(*) filter (embedding[6] > 0.1) as cells from vectors group by 1, 2")
def mask_binary(spark, d):
    return D.mask_binary(_cells(spark, d), 0.1)


# ---- text, equations ----


@query("split_tokens", "select p_partkey, array_to_string(case when t[-1] = '' then t[1:len(t) - 1] else t end, '|') as tokens, len(case when t[-1] = '' then t[1:len(t) - 1] else t end)::int as n from (select p_partkey, string_split(p_name || case when p_partkey % 3 = 0 then '#' else '' end, '#') as t from (select p_partkey, replace(p_name, 'a', '#') as p_name from part))")
def split_tokens(spark, d):
    rows = X.read(spark, d, "part").selectExpr("p_partkey", "concat(replace(p_name, 'a', '#'), case when p_partkey % 3 = 0 then '#' else '' end) as s")
    t = TX.split_tokens(F.col("s"), "#")
    return rows.select("p_partkey", F.array_join(t, "|").alias("tokens"), F.size(t).alias("n"))


@query("round_and_pad", "select p_partkey, regexp_replace(regexp_replace(printf('%.6f', floor(p_retailprice * 10 + 0.5) / 10::double), '0+$', ''), '[.]$', '') as rounded, case when length(p_brand) < 12 then lpad(p_brand, 12, '*') else p_brand end as padded from part")
def round_and_pad(spark, d):
    return X.read(spark, d, "part").select("p_partkey", TX.round_any(F.col("p_retailprice"), 1).alias("rounded"), TX.pad_left(F.col("p_brand"), 12, "*").alias("padded"))


@query("time_format", "select event_id, strftime(ts + interval 8 hour, '%Y/%m/%d at %H:%M:%S.%g') as said from events")
def time_format(spark, d):
    # wall-clock time, so that the session's zone does not matter
    ts = F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    shifted = F.from_utc_timestamp(ts, F.current_timezone()) + F.expr("interval 8 hours")
    return X.read(spark, d, "events").select("event_id", TX.time_format(shifted, "<year>/<mon>/<day> at <hour>:<min>:<sec>.<mili>").alias("said"))


_PLATE_LABELS = "labelled as (select o_orderkey, (o_orderkey % 4)::int as channel_index, (o_orderkey // 4)::int as frame_index, o_custkey // 10 as track_id, (60 + o_custkey % 90)::int as width, 40 as height, case o_custkey % 5 when 0 then 'blue_A' || (100000 + o_custkey % 300) when 1 then 'green_京A' || (10000 + o_custkey % 300) when 2 then 'blue_A1' when 3 then 'a_b_c' else 'yellow_京AF' || (10000 + o_custkey % 200) end as label from orders)"


def _plate_labels(spark, d):
    return X.read(spark, d, "orders").selectExpr(
        "o_orderkey", "cast(o_orderkey % 4 as int) as channel_index", "cast(o_orderkey div 4 as int) as frame_index", "o_custkey div 10 as track_id", "cast(60 + o_custkey % 90 as int) as width", "40 as height",
        "case o_custkey % 5 when 0 then concat('blue_A', 100000 + o_custkey % 300) when 1 then concat('green_京A', 10000 + o_custkey % 300) when 2 then 'blue_A1' when 3 then 'a_b_c' else concat('yellow_京AF', 10000 + o_custkey % 200) end as label",
    )


_PARSED = _PLATE_LABELS + ", parsed as (select *, string_split(label, '_')[1] as color, string_split(label, '_')[2] as text from labelled where len(string_split(label, '_')) = 2 and strlen(string_split(label, '_')[2]) in (7, 9, 10))"


@query("parse_plate", f"with {_PARSED} select o_orderkey, color, text from parsed")
def parse_plate(spark, d):
    p = TX.parse_plate(F.col("label"))
    return _plate_labels(spark, d).where(p.isNotNull()).select("o_orderkey", p["color"].alias("color"), p["text"].alias("text"))


@query("display_label", "select vec_id, case when vec_id % 3 > 0 then '#' || vec_id || ' ' else '' end || 'car|c' || label || '|x' as said from embeddings")
def display_label(spark, d):
    v = X.read(spark, d, "embeddings")
    track = F.when(F.col("vec_id") % 3 > 0, F.col("vec_id")).otherwise(F.lit(-1))
    return v.select("vec_id", TX.display_label(track, F.lit("car"), F.array(F.concat(F.lit("c"), F.col("label").cast("string")), F.lit("x"))).alias("said"))


_TEXTS = """
    texts as (
        select (p_partkey % 4)::int as channel_index, (p_partkey // 12)::int as frame_index, (p_partkey // 4 % 3)::int as target_no, p_partkey,
            case p_partkey % 7 when 0 then p_size || '+' || p_partkey || '=' || (p_size + p_partkey) when 1 then p_size || 'x3=' || (p_size * 3 + p_partkey % 2) when 2 then p_size || '-' || p_partkey
                when 3 then '=' || p_size when 4 then p_size || '÷4=' || (p_size // 4) when 5 then 'a=' || p_size else p_size || '+1=' end as text
        from part),
    sided as (select *, string_split(text, '=') as t from texts),
    arithmetic as (
        select *, regexp_extract(replace(replace(t[1], 'x', '*'), '÷', '/'), '^\\s*([0-9.]+)\\s*([-+*/])\\s*([0-9.]+)\\s*$', ['a', 'op', 'b']) as e,
            regexp_extract(t[2], '^\\s*([+-]?[0-9]+(?:\\.[0-9]*)?)', 1) as said
        from sided),
    flagged as (
        select *, case when len(t) = 2 and t[1] <> '' and t[2] <> '' and e.op <> '' and said <> ''
            then case when v = said::double then 'yes_' else 'no_' end || regexp_replace(regexp_replace(printf('%.6f', floor(v * 100 + 0.5) / 100::double), '0+$', ''), '[.]$', '') else 'invalid' end as flag
        from (select *, case e.op when '+' then try_cast(e.a as double) + try_cast(e.b as double) when '-' then try_cast(e.a as double) - try_cast(e.b as double) when '*' then try_cast(e.a as double) * try_cast(e.b as double) when '/' then try_cast(e.a as double) / try_cast(e.b as double) end as v from arithmetic))"""


def _texts(spark, d):
    return X.read(spark, d, "part").selectExpr(
        "cast(p_partkey % 4 as int) as channel_index", "cast(p_partkey div 12 as int) as frame_index", "cast(p_partkey div 4 % 3 as int) as target_no", "p_partkey",
        "case p_partkey % 7 when 0 then concat(p_size, '+', p_partkey, '=', p_size + p_partkey) when 1 then concat(p_size, 'x3=', p_size * 3 + p_partkey % 2) when 2 then concat(p_size, '-', p_partkey) when 3 then concat('=', p_size) when 4 then concat(p_size, '÷4=', p_size div 4) when 5 then concat('a=', p_size) else concat(p_size, '+1=') end as text",
    )


@query("check_binary", f"with {_TEXTS} select p_partkey, text, flag from flagged")
def check_binary(spark, d):
    return E.check_binary(_texts(spark, d)).select("p_partkey", "text", "flag")


@query("check_equations", f"with {_TEXTS} select p_partkey, text, case when t[1] = 'a' or len(t) < 2 or t[1] = '' or t[2] = '' then 'invalid' else flag end as flag from flagged")
def check_equations(spark, d):
    return E.check_equations(_texts(spark, d)).select("p_partkey", "text", "flag")


@query("equation_summary", f"with {_TEXTS} select channel_index, frame_index, count(*) as total, count(*) filter (flag like 'yes%') as yes, count(*) filter (flag like 'no%') as no, count(*) filter (flag = 'invalid') as invalid, string_agg(text, ',' order by target_no, text) as texts from flagged group by 1, 2")
def equation_summary(spark, d):
    return E.equation_summary(E.check_binary(_texts(spark, d)))


# ---- messages ----


def _boxes(spark, d):
    return numbered(spark, d).select("channel_index", "frame_index", "target_no", "x", "y", "width", "height", "primary_class_id")


_L = " || chr(10) || "
_ITEM = "'{\"x\":' || x || ',\"y\":' || y || ',\"width\":' || width || ',\"height\":' || height || ',\"primary_class_id\":' || primary_class_id || '}'"


@query("json_messages", f"with {NUMBERED} select channel_index, frame_index, '{{\"channel_index\":' || channel_index || ',\"frame_index\":' || frame_index || ',\"width\":800,\"height\":700,\"fps\":25,\"broke_for\":\"normal\",\"normal_size\":' || count(*) || ',\"normal_targets\":[' || string_agg({_ITEM}, ',' order by target_no) || ']}}' as message from numbered group by 1, 2")
def json_messages(spark, d):
    return G.to_json_messages(raw_frames(spark, d).withColumn("fps", F.lit(25)), _boxes(spark, d), "normal", ["x", "y", "width", "height", "primary_class_id"])


_FIELDS = """
    'x': x, 'y': y, 'width': width, 'height': height, 'primary_class_id': primary_class_id, 'primary_score': primary_score, 'primary_label': primary_label, 'channel_index': channel_index, 'frame_index': frame_index, 'track_id': track_id,
    'secondary_class_ids': secondary_class_ids, 'secondary_scores': secondary_scores, 'secondary_labels': secondary_labels, 'sub_targets': sub_targets, 'embeddings': embeddings"""
_TOLD = X.DETECTIONS_SQL + """,
    told as (
        select *, 0.5::double as primary_score, 'class ' || primary_class_id as primary_label, [primary_class_id, 7]::int[] as secondary_class_ids, [0.25::double] as secondary_scores, ['tall']::varchar[] as secondary_labels, []::int[] as embeddings,
            [{'x': x, 'y': y, 'width': width // 2, 'height': height // 2, 'class_id': 1, 'score': 0, 'label': 'plate', 'frame_index': frame_index, 'channel_index': channel_index, 'attachments': []::int[]}] as sub_targets
        from detections)"""


@query("json_all_fields", f"with {_TOLD} select channel_index, frame_index, to_json({{'channel_index': channel_index, 'frame_index': frame_index, 'width': 800, 'height': 700, 'fps': 25, 'broke_for': 'normal', 'normal_size': count(*), 'normal_targets': list({{{_FIELDS}}} order by track_id)}})::varchar as message from told group by channel_index, frame_index")
def json_all_fields(spark, d):
    rows, dealt = X.detections_by_stretch(spark, d).withColumn("target_no", F.col("track_id")), ["frame_index_div"]
    parts = rows.selectExpr("channel_index", "frame_index", *dealt, "target_no", "0 as part_no", "x", "y", "cast(width div 2 as int) as width", "cast(height div 2 as int) as height", "1 as class_id", "'plate' as label")
    # what is made of a row's own columns comes after the join, which sorts the rows
    full = G.with_sub_targets(rows, parts, dealt).selectExpr("*", "0.5D as primary_score", "concat('class ', primary_class_id) as primary_label", "array(primary_class_id, 7) as secondary_class_ids", "array(0.25D) as secondary_scores", "array('tall') as secondary_labels")
    return G.kind_messages(X.frames_by_stretch(spark, d), full, "normal", dealt=dealt)


_XML_ITEM = "    <normal_targets>' || chr(10) || '" + " || chr(10) || ".join(f"        <{c}>' || {c} || '</{c}>'" if k == 0 else f"'        <{c}>' || {c} || '</{c}>'" for k, c in enumerate(("x", "y", "width", "height", "primary_class_id"))) + " || chr(10) || '    </normal_targets>"


@query("xml_messages", f"with {NUMBERED} select channel_index, frame_index, '<message>' {_L} '    <channel_index>' || channel_index || '</channel_index>' {_L} '    <frame_index>' || frame_index || '</frame_index>' {_L} '    <width>800</width>' {_L} '    <height>700</height>' {_L} '    <fps>25</fps>' {_L} '    <broke_for>normal</broke_for>' {_L} '    <normal_size>' || count(*) || '</normal_size>' {_L} string_agg('{_XML_ITEM}', chr(10) order by target_no) {_L} '</message>' as message from numbered group by 1, 2")
def xml_messages(spark, d):
    return G.to_xml_messages(raw_frames(spark, d).withColumn("fps", F.lit(25)), _boxes(spark, d), "normal", ["x", "y", "width", "height", "primary_class_id"])


_WHEN = "strftime(timestamp '2024-01-01 00:00:00' + to_milliseconds(frame_index::bigint * 40), '%Y-%m-%d %H:%M:%S.%g')"


@query("ba_messages", f"with {PB.STOPS} select e.channel_index, e.frame_index, ba_type, '<--' {_L} {_WHEN.replace('frame_index', 'e.frame_index')} {_L} e.channel_index || ',' || e.frame_index {_L} ba_type || ',' || ba_label {_L} e.track_id {_L} '20,30,600,40,600,300,10,300' {_L} coalesce('k' || primary_class_id || '|w' || width, '') {_L} 'i.jpg' {_L} '' {_L} '-->' as message from stop_events e left join detections d using (channel_index, frame_index, track_id)")
def ba_messages(spark, d):
    found = X.detections(spark, d)
    events = PB._stops(spark, d, found).withColumn("fps", F.lit(X.FPS)).withColumn("target_ids", F.array("track_id"))
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in X.REGION])
    events = S.frame_time(events).withColumns({"event_time": F.to_utc_timestamp("frame_ts", "UTC"), "region": ring, "image_name": F.lit("i.jpg"), "video_name": F.lit(None).cast("string"), "event_no": F.xxhash64("channel_index", "frame_index", "track_id", "ba_type")})
    targets = found.withColumn("secondary", F.array(F.concat(F.lit("k"), F.col("primary_class_id").cast("string")), F.concat(F.lit("w"), F.col("width").cast("string"))))
    return G.ba_messages(events, targets, tasks=X.tasks(spark, d))


def _embedded(spark, d):
    v = X.vectors(spark, d)
    return v.select("channel_index", "frame_index", F.lit(0).alias("target_no"), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")).otherwise(F.lit(-1)).alias("track_id"), "embedding", F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("secondary"), F.lit("blue_A123456").alias("sub_label"))


_VEC = "array_to_string(list_transform(embedding, lambda x: printf('%.6g', x)), ',')"
_CROP = "'crops/' || channel_index || '_' || frame_index || '_' || case when vec_id % 2 = 0 then vec_id else 0 end || '.jpg'"


@query("embedding_messages", f"with {X.VECTORS_SQL} select channel_index, frame_index, 0 as target_no, '<--' {_L} {_CROP} {_L} {_VEC} {_L} '-->' as message from vectors")
def embedding_messages(spark, d):
    return G.embedding_messages(_embedded(spark, d), "crops")


@query("property_messages", f"with {X.VECTORS_SQL} select channel_index, frame_index, 0 as target_no, '<--' {_L} {_CROP} {_L} {_VEC} {_L} 'c' || label {_L} 'blue_A123456' {_L} '-->' as message from vectors")
def property_messages(spark, d):
    return G.property_messages(_embedded(spark, d), "crops")


@query("plate_messages", f"with {_PARSED} select channel_index, frame_index, track_id, '<--' {_L} {_WHEN} {_L} channel_index || ',' || frame_index {_L} 'crops/' || channel_index || '_' || frame_index || '_' || track_id || '.jpg' {_L} 'crops/' || channel_index || '_' || frame_index || '.jpg' {_L} color {_L} text {_L} '-->' as message from parsed")
def plate_messages(spark, d):
    rows = S.frame_time(_plate_labels(spark, d).withColumn("fps", F.lit(X.FPS))).withColumn("plate_time", F.col("frame_ts"))
    return G.skip_empty(G.plate_messages(rows, "crops"))


@query("first_per_track", f"with {PB.HISTORY} select channel_index, track_id, min(frame_index) as frame_index from history where history >= 25 and width >= 35 and height >= 26 group by 1, 2")
def first_per_track(spark, d):
    return G.first_per_track(PB.history(spark, d), 25, 35, 26, only_for_tracked=True).select("channel_index", "track_id", "frame_index")


@query("plates_first_per_text", f"with {_PARSED}, once as (select *, row_number() over (partition by channel_index, track_id order by frame_index, track_id) as n from parsed) select channel_index, frame_index, track_id, text from (select *, row_number() over (partition by channel_index, text order by frame_index, track_id) as m from once where n = 1) where m = 1")
def plates_first_per_text(spark, d):
    return G.plates_first_per_text(_plate_labels(spark, d)).select("channel_index", "frame_index", "track_id", "text")


_SENT = _PARSED + """,
    turns as (select *, row_number() over (partition by channel_index order by frame_index, track_id) as n from parsed where width >= 100 and track_id >= 0),
    walk as (
        select channel_index, 0::bigint as n, 0 as frame_index, 0::bigint as track_id, '' as color, '' as text, false as sent, [] ::bigint[] as tracks, [] ::varchar[] as texts from (select distinct channel_index from turns)
        union all
        select t.channel_index, t.n, t.frame_index, t.track_id, t.color, t.text, ok, case when ok then list_append(tracks, t.track_id) else tracks end, case when ok then list_append(texts, t.text) else texts end
        from (select t.*, w.tracks, w.texts, not list_contains(w.tracks, t.track_id) and not list_contains(w.texts, t.text) as ok
            from walk w join turns t on t.channel_index = w.channel_index and t.n = w.n + 1) t)"""


@query("first_per_plate", f"with recursive {_SENT} select channel_index, frame_index, track_id, color, text from walk where sent")
def first_per_plate(spark, d):
    return G.first_per_plate(_plate_labels(spark, d), 8)


# ---- models ----


def _areas(rows: pd.DataFrame) -> pd.DataFrame:
    own = {c: rows[c].to_numpy() for c in ("channel_index", "frame_index", "track_id", "width", "height")}
    area = own.pop("width").astype("int64") * own.pop("height")
    return pd.DataFrame({**own, "area": area})


@query("apply_model", f"with {X.DETECTIONS_SQL} select channel_index, frame_index, track_id, (width * height)::bigint as area from detections")
def apply_model(spark, d):
    return U.apply_model(X.detections(spark, d), _areas, "channel_index int, frame_index int, track_id long, area long")


@query("apply_model_on_targets", f"with {X.DETECTIONS_SQL} select channel_index, frame_index, track_id, (least(width + 20, 800 - greatest(x - 10, 0)) * least(height + 20, 700 - greatest(y - 10, 0)))::bigint as area from detections where width >= 40 and primary_class_id in (1, 3)")
def apply_model_on_targets(spark, d):
    gate, crop = (lambda df: D.gate_targets(df, [1, 3], 40, 0)), (lambda df: D.crop_boxes(df, 800, 700))
    return U.apply_model_on_targets(X.detections(spark, d), _areas, "channel_index int, frame_index int, track_id long, area long", gate=gate, crop=crop)


@query("custom_stages", f"with {X.DETECTIONS_SQL} select channel_index, count(*) as n from detections where width >= 40 group by 1")
def custom_stages(spark, d):
    return U.pipeline(X.detections(spark, d), lambda df: df.where("width >= 40"), lambda df: df.groupBy("channel_index").agg(F.count(F.lit(1)).alias("n")))
