"""Frames, detections and other inputs derived from the driver tables by integer arithmetic, alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vidlake.operators.ordered import busy_frames

FPS, WIDTH, HEIGHT = 25, 800, 700
#: Parameters of the sample scenarios (fixed values).
LINE = ((0, 250), (700, 220))
REGION = ((20, 30), (600, 40), (600, 300), (10, 300))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders of a task that makes detections: some 300,000 rows.
TASK_ORDERS = 20_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks detections are dealt."""
    return 1 + read(spark, sf_dir, "orders").count() // TASK_ORDERS


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked boxes: 20 orders make a track of up to 300 frames, 15 from each order, that drives on or parks for a while.

    Groups of orders are few bytes, which adaptive execution would put into one or two
    tasks, and each becomes 300 rows; so they are dealt out by an explicit number, and
    by channel and track, so that windows and groupings by track add no shuffle of the
    detections. Tracks are sorted before they become rows, as sorting what is in order
    already is one pass.
    """
    orders = read(spark, sf_dir, "orders")
    groups = orders.groupBy(F.expr("o_orderkey div 20").alias("g")).agg(F.min_by("o_custkey", "o_orderkey").alias("ck"), F.array_sort(F.collect_list(F.col("o_orderkey") % 20)).alias("parts"))
    tracks = groups.selectExpr("g * 20 as track_id", "ck", "cast(g % 4 as int) as channel_index", "cast(g div 4 as int) as slot", "flatten(transform(parts, i -> sequence(cast(i * 15 as int), cast(i * 15 + 14 as int)))) as ts")
    src = tracks.repartition(tasks(spark, sf_dir), "channel_index", "track_id").sortWithinPartitions("track_id")
    points = src.withColumn("t", F.explode("ts")).where("not (ck % 7 = 0 and (t + ck) % 41 = 0) and not (ck % 11 = 0 and t between 40 and 70)")
    return points.selectExpr(
        "channel_index", "cast(slot * 5 + t as int) as frame_index", "track_id", "cast(20 + (ck % 25) * 20 as int) as x",
        "cast(case when (slot div 40) % 2 = 0 and ck % 3 <> 0 then case when t < 20 then t * 6 when t < 260 then 120 + (t + ck) % 3 else 120 + (t - 260) * 6 end else t * 2 end as int) as y",
        "cast(30 + ck % 20 as int) as width", "cast(24 + track_id % 12 as int) as height", "cast(ck % 5 as int) as primary_class_id",
    )


def detections_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections dealt out by channel and frame, in as many tasks, while their rows are still narrow: joins, windows and groupings of frames add no shuffle."""
    return detections(spark, sf_dir).repartition(tasks(spark, sf_dir), "frame_index", "channel_index")


#: Frame numbers that are dealt together by detections_by_stretch: 2 to this power.
STRETCH_BITS = 6


def _stretch():
    return F.shiftright("frame_index", STRETCH_BITS).alias("frame_index_div")


def detections_by_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections with frame_index_div, dealt out by it and the channel: groupings by frame add no shuffle where it is among their keys.

    A track's rows of a stretch go on together, and as they differ little, they take a
    small part of the bytes that they take when each frame goes elsewhere. A box is one
    array, so branches that need some of its numbers read the same columns, and share
    one shuffle.
    """
    rows = detections(spark, sf_dir).select("channel_index", "frame_index", _stretch(), "track_id", F.array("x", "y", "width", "height", "primary_class_id").alias("box"))
    # rows without a number are on no frame; left out here, they are not filtered again below one branch's shuffle alone
    whole = rows.dropna(subset=["frame_index", "channel_index", "track_id", "frame_index_div"])
    dealt = whole.repartition(tasks(spark, sf_dir), "frame_index_div", "channel_index")
    return dealt.select("channel_index", "frame_index", "frame_index_div", "track_id", *[F.get("box", k).alias(c) for k, c in enumerate(("x", "y", "width", "height", "primary_class_id"))])


def frames_by_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that detections are on, dealt out as detections_by_stretch."""
    return frames(spark, sf_dir).select("*", _stretch()).repartition(tasks(spark, sf_dir), "frame_index_div", "channel_index")


DETECTIONS_SQL = """
    tracks_src as (
        select (o_orderkey // 20) * 20 as track_id, first_value(o_custkey) over (partition by o_orderkey // 20 order by o_orderkey) as ck,
            ((o_orderkey // 20) % 4)::int as channel_index, ((o_orderkey // 20) // 4)::int as slot, o_orderkey % 20 * 15 as t0
        from orders),
    points as (
        select *, case when (slot // 40) % 2 = 0 and ck % 3 <> 0
                then case when t < 20 then t * 6 when t < 260 then 120 + (t + ck) % 3 else 120 + (t - 260) * 6 end else t * 2 end as y0
        from (select *, unnest(generate_series(t0, t0 + 14)) as t from tracks_src)),
    detections as (
        select channel_index, (slot * 5 + t)::int as frame_index, track_id, (20 + (ck % 25) * 20)::int as x, y0::int as y,
            (30 + ck % 20)::int as width, (24 + track_id % 12)::int as height, (ck % 5)::int as primary_class_id
        from points where not (ck % 7 = 0 and (t + ck) % 41 = 0) and not (ck % 11 = 0 and t between 40 and 70))"""


def frames_of(targets: DataFrame) -> DataFrame:
    """The frames that targets are on."""
    return busy_frames(targets).selectExpr("*", f"{FPS} as fps", f"{WIDTH} as width", f"{HEIGHT} as height")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that detections are on."""
    return frames_of(detections(spark, sf_dir))


FRAMES_SQL = DETECTIONS_SQL + f""",
    frames as (select distinct channel_index, frame_index, {FPS} as fps, {WIDTH} as width, {HEIGHT} as height from detections)"""


def channel_config(spark: SparkSession) -> DataFrame:
    """The line and the region of each channel: one row a channel."""
    ends = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in LINE)
    ring = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in REGION)
    return spark.range(4).selectExpr("cast(id as int) as channel_index", f"array({ends}) as line", f"array({ring}) as ring")


#: Rows of detector output of a task.
TASK_ROWS = 150_000


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output: one row of values a line item; dealt out by frame and an explicit number, so that a task's rows do not grow with the table."""
    rows = read(spark, sf_dir, "lineitem")
    placed = rows.selectExpr("cast(l_orderkey % 4 as int) as channel_index", "cast(l_orderkey div 4 as int) as frame_index", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return placed.repartition(1 + rows.count() // TASK_ROWS, "channel_index", "frame_index").selectExpr(
        "channel_index", "frame_index", "cast(l_suppkey % 3 as int) as head", "l_linenumber as row_no",
        "array((l_partkey % 400) / 400D, (l_suppkey % 300) / 300D, l_quantity / 100, l_quantity / 80, l_discount * 10, l_tax * 10, l_discount * 9, l_linenumber / 8D) as values",
    )


RAW_ROWS_SQL = """
    raw_rows as (
        select (l_orderkey % 4)::int as channel_index, (l_orderkey // 4)::int as frame_index, (l_suppkey % 3)::int as head, l_linenumber as row_no,
            [(l_partkey % 400) / 400.0::double, (l_suppkey % 300) / 300.0::double, l_quantity / 100, l_quantity / 80, l_discount * 10, l_tax * 10, l_discount * 9, l_linenumber / 8.0::double] as v
        from lineitem)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node trace: one row an event; node and port by its type, frame by its number."""
    return read(spark, sf_dir, "events").selectExpr(
        "cast(user_id % 4 as int) as channel_index", "cast(event_id div 4 as int) as frame_index", "event_type as node", "event_id",
        "case when event_id % 2 = 0 then 'in' else 'out' end as port", "ts as in_time",
        "ts + make_dt_interval(0, 0, 0, cast((event_id % 90) / 1000.0 as decimal(18, 6))) as out_time",
    )


TRACE_SQL = """
    trace as (
        select (user_id % 4)::int as channel_index, (event_id // 4)::int as frame_index, event_type as node, event_id,
            case when event_id % 2 = 0 then 'in' else 'out' end as port, ts as in_time, ts + to_milliseconds((event_id % 90)::int) as out_time
        from events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target embeddings: channel and frame from the vector's number, in double."""
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "cast(vec_id % 4 as int) as channel_index", "cast(vec_id div 4 as int) as frame_index", "label", "cast(embedding as array<double>) as embedding"
    )


VECTORS_SQL = """
    vectors as (
        select vec_id, (vec_id % 4)::int as channel_index, (vec_id // 4)::int as frame_index, label, embedding::double[] as embedding from embeddings)"""
