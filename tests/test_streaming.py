"""A replay of files through the streaming operators gives what the batch operators give."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vidlake import fixtures as X
from vidlake.operators import behaviour as B, models as U, track as T
from vidlake.plans import behaviour as PB
from vidlake.sources import frames as S, pushed as P
from vidlake.streaming import channels as C, events as E

SF = "/root/testdata/sf0.001"
LINES = {k: X.LINE for k in range(4)}
REGIONS = {k: list(X.REGION) for k in range(4)}


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """detections of channel 0 and 1 in two files, the earlier frames first."""
    path = str(tmp_path_factory.mktemp("replay"))
    rows = X.detections(spark, SF).where("channel_index < 2").selectExpr("*", "25 as fps").cache()
    for where in ("frame_index < 400", "frame_index >= 400"):
        rows.where(where).coalesce(1).write.mode("append").parquet(path)
    return path, rows.schema


def collected(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return {tuple(r) for r in spark.table(name).collect()}


def stream(spark, replay):
    return spark.readStream.schema(replay[1]).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(replay[0])


def test_cross_line(spark, replay, tmp_path):
    got = collected(spark, C.cross_line_stream(stream(spark, replay), LINES), tmp_path, "crossed")
    want = PB.QUERIES["cross_line"](spark, SF).where("channel_index < 2").select("channel_index", "frame_index", "ba_type", "track_id")
    assert got == {tuple(r) for r in want.collect()} and len(got) == 38


def test_stops_and_jams(spark, replay, tmp_path):
    got = collected(spark, C.stop_stream(stream(spark, replay), REGIONS), tmp_path, "stopped")
    want = PB.QUERIES["stop_events"](spark, SF).where("channel_index < 2").select("channel_index", "frame_index", "ba_type", "track_id")
    assert got == {tuple(r) for r in want.collect()} and sum(r[2] == B.STOP for r in got) == 23
    got = collected(spark, C.jam_stream(stream(spark, replay), REGIONS), tmp_path, "jammed")
    want = PB.QUERIES["jam_events"](spark, SF).where("channel_index < 2").select("channel_index", "frame_index", "ba_type")
    assert got == {tuple(r) for r in want.collect()} and (0, 251, B.JAM) in got and (0, 287, B.UNJAM) in got


def test_tracking(spark, replay, tmp_path):
    rows = stream(spark, replay).selectExpr("*", "cast(track_id as int) as target_no")
    got = collected(spark, C.sort_track_stream(rows), tmp_path, "tracked")
    batch = X.detections(spark, SF).where("channel_index < 2").selectExpr("channel_index", "frame_index", "cast(track_id as int) as target_no", "x", "y", "width", "height")
    want = {tuple(r) for r in T.sort_track(batch, 4).select("channel_index", "frame_index", "target_no", "track_id").collect()}
    assert got == want


def test_windows_and_dedupe(spark, tmp_path):
    trace = X.trace(spark, SF).selectExpr("channel_index", "cast(in_time as timestamp) as in_time", "node", "cast(event_id div 50 as string) as control_uid", "cast(in_time as timestamp) as create_time")
    trace.coalesce(1).write.parquet(str(tmp_path / "trace"))
    source = spark.readStream.schema(trace.schema).parquet(str(tmp_path / "trace"))
    fps = collected(spark, E.output_fps_stream(source, 3_600_000), tmp_path, "fps")
    assert 0 < len(fps)
    once = collected(spark, E.dedupe_controls_stream(source.select("channel_index", "control_uid", "create_time"), "1000 days"), tmp_path, "controls")
    assert len(once) == trace.select("channel_index", "control_uid").distinct().count()


def test_sync(spark, tmp_path):
    frames = spark.range(20).selectExpr("0 as channel_index", "cast(id as int) as frame_index", "timestamp_millis(1700000000000 + id * 1000) as frame_ts", "array(id) as targets")
    for name, where in (("a", "frame_index % 3 > 0"), ("b", "frame_index % 4 > 0")):
        frames.where(where).coalesce(1).write.parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(frames.schema).parquet(str(tmp_path / n)) for n in "ab")
    got = collected(spark, E.sync_stream(a, b).selectExpr("frame_index", "size(targets) as n", "alone"), tmp_path, "synced")
    both = {(k, 2, False) for k in range(20) if k % 3 and k % 4}
    # a frame of one branch goes on alone once the watermark has passed it: all but the newest
    lone = {(k, 1, True) for k in range(20) if (k % 3 > 0) != (k % 4 > 0)}
    newest = max(k for k in range(20) if k % 3 or k % 4)
    assert got - lone == both and lone - got <= {(newest, 1, True)}


def test_files_as_a_stream_and_callbacks(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).selectExpr("0 as channel_index", "cast(id as int) as frame_index").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    frames = S.read_stream(spark, str(tmp_path / "in"), "channel_index int, frame_index int", max_files_per_trigger=1)
    q = U.on_results(frames, lambda df, batch: seen.append(df.count()), checkpointLocation=str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen == [10, 10, 10]
    sent = S.write_messages(frames.selectExpr("cast(frame_index as string) as message"), "text", str(tmp_path / "out"), checkpointLocation=str(tmp_path / "d"))
    sent.processAllAvailable()
    sent.stop()
    assert spark.read.text(str(tmp_path / "out")).count() == 30


def test_first_per_track(spark, tmp_path):
    rows = [(0, f, t, 60, 60, f + 1) for t in (1, 2) for f in range(30)] + [(0, f, -1, 60, 60, 0) for f in range(2)] + [(0, 3, 3, 10, 60, 1)]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, track_id long, width int, height int, history int").withColumn("frame_ts", F.timestamp_millis(F.col("frame_index") * 40))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    tracked = collected(spark, E.first_per_track_stream(source, only_for_tracked=True).select("track_id", "history"), tmp_path, "tracked_once")
    assert {t for t, _ in tracked} == {1, 2} and len(tracked) == 2 and all(h >= 25 for _, h in tracked)
    every = collected(spark, E.first_per_track_stream(source).select("track_id", "frame_index"), tmp_path, "all_once")
    assert sorted(t for t, _ in every) == [-1, -1, 1, 2]


def test_sync_by_frame_distance(spark, tmp_path):
    frames = lambda ids: spark.createDataFrame([(0, k, 25, [k]) for k in ids], "channel_index int, frame_index int, fps int, targets array<long>")
    # two files a branch: what waits at the end of the first meets the second
    for name, parts in (("a", ([0, 1, 2, 5], [6, 7, 9, 20])), ("b", ([0, 2, 3, 5], [1, 7, 8, 9]))):
        for ids in parts:
            frames(ids).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(frames([0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in "ab")
    got = collected(spark, C.sync_frames_stream(a, b, 80).selectExpr("frame_index", "array_join(targets, ',') as t", "alone"), tmp_path, "synced_by_frame")
    assert {(0, "0,0", False), (2, "2,2", False), (5, "5,5", False), (7, "7,7", False), (9, "9,9", False)} <= got
    assert got - {(k, f"{k},{k}", False) for k in (0, 2, 5, 7, 9)} == {(1, "1", True), (3, "3", True), (6, "6", True), (8, "8", True)}


def test_first_seen(spark, tmp_path):
    v = X.vectors(spark, SF).select("channel_index", "frame_index", "vec_id", "embedding").cache()
    for where in ("frame_index < 60", "frame_index >= 60"):
        v.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    source = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    got = collected(spark, C.first_seen_stream(source).select("channel_index", "vec_id", "cosine", "l2"), tmp_path, "faces")
    from vidlake.operators.embed import first_seen_identities

    assert got == {tuple(r) for r in first_seen_identities(v, 4).collect()}


def stopped_half_way(spark, replay, tmp_path, operator, name):
    """Rows of a query that is stopped after the first file and started again from its checkpoint, with a source of both."""
    out, parts = set(), sorted(replay[0].glob("part-*"), key=lambda p: p.stat().st_mtime)
    place = tmp_path / f"{name}_in"
    place.mkdir()
    for n, part in enumerate(parts):
        (place / f"{n}.parquet").write_bytes(part.read_bytes())
        source = spark.readStream.schema(replay[1]).parquet(str(place))
        q = operator(source).writeStream.foreachBatch(lambda df, _: out.update(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    return out


@pytest.mark.parametrize("name", ["jam", "track"])
def test_restart_from_a_checkpoint(spark, replay, tmp_path, name):
    from pathlib import Path

    numbered = lambda s: s.selectExpr("*", "cast(track_id as int) as target_no")
    operator = {
        "jam": lambda s: C.jam_stream(s, REGIONS),
        "track": lambda s: C.sort_track_stream(numbered(s)),
    }[name]
    got = stopped_half_way(spark, (Path(replay[0]), replay[1]), tmp_path, operator, name)
    assert got == collected(spark, operator(stream(spark, replay)), tmp_path, f"whole_{name}") and got


def test_state_is_an_entry_a_track_and_is_forgotten(spark, replay, tmp_path):
    collected(spark, C.cross_line_stream(stream(spark, replay), LINES), tmp_path, "entries")
    kept = spark.read.format("statestore").option("path", str(tmp_path / "entries")).option("stateVarName", "tracks").load()
    kept = kept.selectExpr("key.channel_index as c", "user_map_key.track_id as t", "user_map_value.last as last") if "user_map_key" in kept.columns else kept.selectExpr("key.channel_index as c", "explode(map_value) as (k, v)").selectExpr("c", "k.track_id as t", "v.last as last")
    rows = X.detections(spark, SF).where("channel_index < 2")
    last = {r.channel_index: r.m for r in rows.groupBy("channel_index").agg(F.max("frame_index").alias("m")).collect()}
    live = {(r.channel_index, r.track_id) for r in rows.collect() if last[r.channel_index] - r.frame_index <= T.MAX_GAP}
    got = [(r.c, r.t) for r in kept.collect()]
    assert sorted(got) == sorted(live) and len(got) < rows.select("track_id").distinct().count()


def test_state_expires(spark, tmp_path):
    import time

    rows = lambda frames: spark.createDataFrame([(0, f, 25, 1, 10, y, 10, 10) for f, y in frames], "channel_index int, frame_index int, fps int, track_id long, x int, y int, width int, height int")
    line = {0: ((0, 100), (700, 100))}
    got = {}
    for ttl in (None, 1500):
        place, seen = tmp_path / f"in{ttl}", set()
        rows([(0, 50)]).coalesce(1).write.mode("append").parquet(str(place))
        source = spark.readStream.schema(rows([(0, 0)]).schema).parquet(str(place))
        q = C.cross_line_stream(source, line, ttl).writeStream.foreachBatch(lambda df, _, seen=seen: seen.update(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / f"c{ttl}")).trigger(processingTime="300 milliseconds").start()
        until = time.time() + 60
        while not (q.lastProgress and any(p["numInputRows"] for p in q.recentProgress)) and time.time() < until:
            time.sleep(0.2)
        time.sleep(3)
        rows([(1, 150)]).coalesce(1).write.mode("append").parquet(str(place))
        until = time.time() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < 2 and time.time() < until:
            time.sleep(0.2)
        time.sleep(1)
        q.stop()
        got[ttl] = seen
    assert got[None] == {(0, 1, B.CROSSLINE, 1)} and got[1500] == set()


def timed(spark, ids):
    return spark.createDataFrame([(0, k, 25, [k]) for k in ids], "channel_index int, frame_index int, fps int, targets array<long>").withColumn("frame_ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("frame_index") * 40))


def test_a_silent_branch_holds_nothing_back(spark, tmp_path):
    # b stops after frame 2; another channel goes on and moves the watermark
    files = {"a": ([0, 1, 2, 3], [100], [100, 101]), "b": ([0, 1, 2], [100], [1, 101])}
    for name, parts in files.items():
        for n, ids in enumerate(parts):
            rows = timed(spark, ids)
            if n:
                rows = rows.withColumn("channel_index", F.when(F.col("frame_index") < 50, 0).otherwise(1))
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(timed(spark, [0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in "ab")
    out = C.sync_frames_stream(a, b, 80, release="0 seconds", with_late=True)
    got = collected(spark, out.selectExpr("channel_index", "frame_index", "array_join(targets, ',') as t", "alone", "late"), tmp_path, "silent")
    assert {r[:4] for r in got if r[0] == 0 and not r[4]} == {(0, k, f"{k},{k}", False) for k in (0, 1, 2)} | {(0, 3, "3", True)}
    assert (1, 100, "100,100", False, False) in got and (1, 101, "101,101", False, False) in got


def test_late_frames_are_told(spark, tmp_path):
    for name, parts in (("a", ([0, 1, 2, 5], [6, 7])), ("b", ([0, 2, 5], [1, 7]))):
        for ids in parts:
            timed(spark, ids).drop("frame_ts").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(timed(spark, [0]).drop("frame_ts").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in "ab")
    out = C.sync_frames_stream(a, b, 80, with_late=True)
    got = collected(spark, out.selectExpr("frame_index", "alone", "late"), tmp_path, "told")
    assert {r for r in got if r[2]} == {(1, True, True)} and (1, True, False) in got


def test_controls_keep_their_place(spark, tmp_path):
    kinds = "channel_index int, frame_index int, fps int, targets array<long>, control_uid string"
    frame, control = lambda k: (0, k, 25, [k], None), lambda k, uid: (0, k, 25, [], uid)
    parts = {"a": ([frame(0), control(1, "x"), frame(1)], [frame(2), control(3, "y"), frame(3), frame(9)]), "b": ([control(0, "w"), frame(0)], [control(1, "x"), frame(1), frame(3)])}
    for name, files in parts.items():
        for rows in files:
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in "ab")
    out, seen = C.sync_frames_stream(a, b, 80), []
    q = out.writeStream.foreachBatch(lambda df, _: seen.extend((r.frame_index, r.control_uid, r.alone) for r in df.coalesce(1).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    # the second "x" is that of the other branch; frame 2 has no partner and goes on alone before what follows it
    assert seen[:5] == [(0, "w", False), (0, None, False), (1, "x", False), (1, None, False), (3, None, False)]
    assert seen[5:] == [(2, None, True), (3, "y", False)]


def test_stale_ports_stream(spark, tmp_path):
    def rows(*events):
        return spark.createDataFrame([(n, "in", float(s)) for n, s in events], "node string, port string, s double").withColumn("in_time", F.timestamp_millis((F.col("s") * 1000).cast("long"))).drop("s")

    parts = [[("a", 0), ("b", 1), ("a", 3)], [("a", 6), ("a", 7), ("a", 8)], [("a", 12), ("b", 12.5), ("a", 13)], [("a", 17)], [("a", 21)], [("a", 25)]]
    for events in parts:
        rows(*events).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows(("a", 0)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(spark, E.stale_ports_stream(source).selectExpr("node", "unix_millis(at) as ms", "stale"), tmp_path, "stale")
    assert got == {("b", 6000, True), ("b", 12500, False), ("b", 17500, True)}


def test_first_per_plate_stream(spark, tmp_path):
    from vidlake.operators import messages as M

    rng = random.Random(2)
    rows = [(c, f, rng.randrange(12), rng.choice((90, 120)), 40, rng.choice(("blue_A123456", "blue_B123456", "green_C1234567", "blue_A1", "red_D123456"))) for c in range(2) for f in range(80)]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, track_id long, width int, height int, label string")
    for where in ("frame_index < 30", "frame_index >= 30"):
        df.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(spark, C.first_per_plate_stream(source), tmp_path, "plates")
    want = M.first_per_plate(df).select("channel_index", "frame_index", "track_id", "color", "text")
    assert got == {tuple(r) for r in want.collect()} and len(got) > 3


def test_pushed_batches(spark, tmp_path):
    rng = random.Random(3)
    place, out = str(tmp_path / "inbox"), []
    frames = lambda n: pd.DataFrame([(rng.randrange(2), rng.choice((800, 800, 800, 810)) if n % 3 else 800, 600, k) for k in range(6)], columns=["channel_index", "width", "height", "no"])
    pushed, inbox = [], P.Inbox(place)

    def run():
        rows = P.accepted_batches_stream(P.read_pushed(spark, place, "channel_index int, width int, height int, no int"))
        q = rows.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for part in range(2):  # the second run starts again from the checkpoint
        for _ in range(4):
            own = frames(len(pushed)).astype("int32")
            assert inbox.push(own) == len(pushed)
            pushed.append(own)
        inbox = P.Inbox(place)  # the application too
        run()
    run()
    every = pd.concat([b.assign(batch_no=n) for n, b in enumerate(pushed)])
    rows = spark.createDataFrame([tuple(map(int, r)) for r in every.itertuples(index=False)], "channel_index int, width int, height int, no int, batch_no long")
    want = S.accepted_batches(rows).select("channel_index", "width", "height", "no", "batch_no", "fps")
    assert sorted(out) == sorted(map(tuple, want.collect())) and 0 < len(out) < len(every)
