"""Hand-made frames for the rules that the derived fixtures don't reach."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake import fixtures as X
from vidlake.functions import geometry as G, text as TX
from vidlake.operators import behaviour as B, decode as D, embed as E, equations as Q, flow as W, joins as J, messages as M, models as U, record as R, track as T
from vidlake.sources import frames as S


def boxes(spark, rows):
    """(channel, frame, track, x, y) of 10 by 10 boxes."""
    return spark.createDataFrame([(*r, 10, 10) for r in rows], "channel_index int, frame_index int, track_id long, x int, y int, width int, height int")


def frames(spark, n, channel=0):
    return spark.range(n).selectExpr(f"{channel} as channel_index", "cast(id as int) as frame_index", "25 as fps", "800 as width", "700 as height")


def line(spark, a, b):
    return spark.createDataFrame([(0, [a, b])], "channel_index int, line array<struct<x:int,y:int>>")


@pytest.mark.parametrize("a, b, p, side", [((5, 0), (5, 9), (4, 0), True), ((5, 0), (5, 9), (5, 0), False), ((0, 5), (9, 5), (0, 4), True), ((0, 5), (9, 5), (0, 5), False), ((0, 0), (10, 10), (100, 101), True), ((10, 10), (0, 0), (100, 101), True), ((0, 0), (10, 10), (5, 5), False), ((0, 0), (10, 10), (7, 3), False)])
def test_side_of_line(spark, a, b, p, side):
    df = line(spark, a, b).select(G.side_of_line(F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y")), F.col("line")).alias("s"))
    assert df.first().s is side


def test_several_crossings(spark):
    rows = boxes(spark, [(0, f, 1, x, 0) for f, x in enumerate([0, 20, 0, 0, 20])])
    got = B.cross_line(T.track_history(rows), line(spark, (15, 0), (15, 9)))
    assert sorted(r.frame_index for r in got.collect()) == [1, 2, 4]


def test_history_restarts_only_when_the_channel_was_busy(spark):
    track = [(0, 0, 1, 0, 0), (0, 1, 1, 0, 0), (0, 40, 1, 0, 0)]
    quiet = T.track_history(boxes(spark, track)).orderBy("frame_index").collect()
    busy = T.track_history(boxes(spark, [*track, *[(0, f, 2, 50, 50) for f in range(10, 39)]])).where("track_id = 1").orderBy("frame_index").collect()
    assert [r.history for r in quiet] == [1, 2, 3] and [r.history for r in busy] == [1, 2, 1]


@pytest.mark.parametrize("hits, total, stops, unstops", [(49, 60, 0, 0), (50, 60, 1, 1), (51, 60, 1, 1), (51, 51, 1, 0)])
def test_stop_runs(spark, hits, total, stops, unstops):
    got = B.stop_events(boxes(spark, [(0, f, 1, 0, 0) for f in range(hits)]), frames(spark, total)).collect()
    assert sum(r.ba_type == B.STOP for r in got) == stops and sum(r.ba_type == B.UNSTOP for r in got) == unstops


def test_an_empty_frame_breaks_a_run(spark):
    rows = boxes(spark, [(0, f, 1, 0, 0) for f in range(70) if f != 30])
    assert B.stop_events(rows, frames(spark, 70)).count() == 0


def test_jam_waits_and_is_not_repeated_soon(spark):
    counts = lambda full: frames(spark, 1000).withColumn("stops", F.when(full, 8).otherwise(0))
    f = F.col("frame_index")
    got = B.jam_events(counts(f.between(100, 300) | f.between(400, 450) | f.between(500, 700))).orderBy("frame_index").collect()
    assert [(r.frame_index, r.ba_type) for r in got] == [(251, B.JAM), (301, B.UNJAM), (552, B.JAM), (701, B.UNJAM)]


def test_one_track_on_two_boxes_still_stops(spark):
    rows = [(0, f, 1, 100, 100) for f in range(80)]
    both = boxes(spark, rows).withColumn("target_no", F.lit(0)).unionByName(boxes(spark, rows).withColumn("target_no", F.lit(1)))
    assert T.one_per_track(both).count() == 80


def test_nms_keeps_no_overlap(spark):
    rng = np.random.default_rng(4)
    rows = [(0, 0, k, int(x), int(y), 40, 40, 1, float(s)) for k, (x, y, s) in enumerate(zip(rng.integers(0, 150, 60), rng.integers(0, 150, 60), rng.integers(1, 9, 60) / 10))]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, row_no int, x int, y int, width int, height int, primary_class_id int, primary_score double")
    kept = D.nms(df, 0.5).collect()
    b = np.array([(r.x, r.y, r.width, r.height) for r in kept], float)
    like = T.overlap(b, b)
    assert (like[~np.eye(len(b), dtype=bool)] <= 0.5).all() and [r.primary_score for r in kept] == sorted((r.primary_score for r in kept), reverse=True)
    assert len(D.nms(df, 0.5, top_k=10).collect()) <= 10


def test_clip_does_not_shrink_by_what_was_left_of_the_frame(spark):
    got = D.clip_boxes(boxes(spark, [(0, 0, 1, -4, 5), (0, 0, 2, 795, 5), (0, 0, 3, 800, 5)]), frames(spark, 1)).orderBy("track_id").collect()
    assert [(r.track_id, r.x, r.width) for r in got] == [(1, 0, 10), (2, 795, 5)]


@pytest.mark.parametrize("text, flag", [("1+1=2", "yes_2"), ("2x3=7", "no_6"), ("1+1", "invalid"), ("=2", "invalid"), ("1+1=", "invalid"), ("6÷4=1.5", "yes_1.5"), ("a=1", "invalid"), ("(1+2)x3=9", "yes_9"), ("1÷0=1", "invalid")])
def test_equations(spark, text, flag):
    df = spark.createDataFrame([(text,)], "text string")
    assert Q.check_equations(df).first().flag == flag
    if "(" not in text:
        assert Q.check_binary(df).first().flag == flag


def test_plates(spark):
    labels = ["blue_A123456", "blue_京A12345", "blue_A1", "blue_A123456"]
    rows = [(0, k, k if k != 3 else 9, 120, 40, v) for k, v in enumerate(labels)]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, track_id long, width int, height int, label string")
    assert [r.text for r in M.first_per_plate(df, 2).orderBy("frame_index").collect()] == ["A123456", "京A12345"]
    # a track whose row its text held back is still unused
    more = [(0, 0, 1, 120, 40, "blue_A123456"), (0, 1, 2, 120, 40, "blue_A123456"), (0, 2, 2, 120, 40, "blue_A123457")]
    assert M.first_per_plate(spark.createDataFrame(more, df.schema), 2).count() == 2


def test_pairs_in_order_of_arrival(spark):
    rows = [(c, k, k) for k, c in enumerate([1, 1, 0, 0, 1, 0])]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, create_time int")
    assert sorted(map(tuple, W.pair_channels(df, 0, 1).collect())) == [(2, 1), (5, 4)]


def test_pairs_across_stretches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), k, int(t), None if k % 2 else 1) for k, t in enumerate(sorted(rng.integers(0, 20_000, 300)))]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, create_time int, pair int")

    def plain(rows):
        rows = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
        return sorted((b[1], a[1]) for a, b in zip(rows, rows[1:]) if (a[0], b[0]) == (1, 0))

    assert sorted(map(tuple, W.pair_channels(df, 0, 1).collect())) == plain(rows)
    got = W.pair_channels(df.withColumn("create_time", F.timestamp_seconds(F.col("create_time"))), 0, 1, ["pair"]).collect()
    for g in (None, 1):
        assert sorted((r.src_frame, r.dst_frame) for r in got if r.pair == g) == plain([r for r in rows if r[3] == g])


def test_clips_make_up_for_a_short_past(spark):
    asked = spark.createDataFrame([(1, 0, 1, 0), (2, 0, 499, 0)], "clip_id int, channel_index int, frame_index int, duration int")
    clips = R.select_clips(frames(spark, 2000), asked)
    info = {r.clip_id: (r.first_frame, r.last_frame, r.frames, r.complete) for r in R.record_info(clips, asked, 25).collect()}
    assert info == {1: (0, 624, 625, True), 2: (374, 998, 625, True)}


def test_tracker(spark):
    rows = [(0, f, k, x, y, 40, 40) for f in range(12) for k, (x, y) in enumerate([(100 + 5 * f, 100), (400 - 5 * f, 300)]) if (f, k) != (7, 0)]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, target_no int, x int, y int, width int, height int")
    got = {(r.frame_index, r.target_no): r.track_id for r in T.sort_track(df, 2).collect()}
    assert [got[f, 0] for f in range(4)] == [-1, -1, -1, 1] and got[11, 0] == 1 and {got[f, 1] for f in range(3, 12)} == {2}


def scalar_sort(frames):
    """The tracker box by box: one 7-state filter a tracker, the assignment by trying every one."""
    move = np.eye(7) + np.diag([1.0] * 3, 4)
    look = np.eye(4, 7)

    def rect(x):
        w = np.sqrt(x[2] * x[3])
        lo = [x[0] - w / 2, x[1] - x[2] / w / 2]
        return np.array([0 if lo[k] < 0 < x[k] else lo[k] for k in (0, 1)] + [w, x[2] / w])

    def iou(a, b):
        i = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return i / (a[2] * a[3] + b[2] * b[3] - i)

    start = lambda d, k: {"x": np.array([d[0] + d[2] / 2, d[1] + d[3] / 2, d[2] * d[3], d[2] / d[3], 0, 0, 0]), "p": np.eye(7), "id": k, "age": 0, "streak": 0}
    live, count, out = [], 0, []
    for dets in frames:
        ids, taken, first = [-1] * len(dets), set(), not live
        for t in live:
            t["x"], t["p"] = move @ t["x"], move @ t["p"] @ move.T + 0.01 * np.eye(7)
            t["streak"] = 0 if t["age"] > 0 else t["streak"]
            t["age"] += 1
        live = [t for t in live if (rect(t["x"])[:2] >= 0).all()]
        n, m = len(live), len(dets)
        like = [[iou(rect(t["x"]), d) for d in dets] for t in live]
        k = min(n, m)
        best = max(([*zip(r, c)] for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k)), key=lambda ps: sum(like[i][j] for i, j in ps), default=[])
        for i, j in best:
            if like[i][j] >= 0.5:
                t, d = live[i], dets[j]
                gain = t["p"] @ look.T @ np.linalg.inv(look @ t["p"] @ look.T + 0.1 * np.eye(4))
                t["x"] = t["x"] + gain @ (np.array([d[0] + d[2] / 2, d[1] + d[3] / 2, d[2] * d[3], d[2] / d[3]]) - t["x"][:4])
                t["p"] = (np.eye(7) - gain @ look) @ t["p"]
                t["age"], t["streak"] = 0, t["streak"] + 1
                taken.add(j)
        for t in [] if first else live:
            if t["age"] < 1 and t["streak"] >= 3:
                for j, d in enumerate(dets):
                    if iou(rect(t["x"]), d) > 0.8:
                        ids[j] = t["id"]
        live = [t for t in live if t["age"] <= 1]
        for j, d in enumerate(dets):
            if j not in taken:
                count += 1
                live.append(start(d, count))
        out.append(ids)
    return out


def test_tracker_against_a_scalar_one():
    rng = np.random.default_rng(8)
    for _ in range(15):
        at, step, size = rng.integers(0, 300, (3, 2)).astype(float), rng.integers(-6, 7, (3, 2)), rng.integers(30, 60, (3, 2))
        frames_ = []
        for f in range(25):
            rows = [[*np.round(at[k] + step[k] * f + rng.integers(-1, 2, 2)), *size[k]] for k in range(3) if rng.random() > 0.12]
            frames_.append(np.array(rows, float).reshape(-1, 4))
        trackers = T.Trackers()
        assert [trackers.step(d).tolist() for d in frames_] == scalar_sort([d.tolist() for d in frames_])


def test_a_limb_joins_the_first_person_that_holds_its_joint(spark):
    # two persons come to hold joint 7 as their second point; the third limb goes to the first of them
    pairs = [(0, 0, 0, 1, 7), (0, 0, 0, 2, 7), (0, 0, 1, 7, 9), (0, 0, 2, 5, 6)]
    df = spark.createDataFrame(pairs, "channel_index int, frame_index int, limb int, a_id int, b_id int")
    got = {r.person: r.joints for r in D.assemble_poses(df, [(0, 1), (1, 2), (2, 3)], 3 + 1).collect()}
    assert got == {0: [1, 7, 9, -1], 1: [2, 7, -1, -1], 2: [-1, -1, 5, 6]}
    # beyond the number of points less one no limb starts a person
    assert len(D.assemble_poses(df, [(0, 1), (1, 2), (2, 0)], 3).collect()) == 2


def test_first_per_track_defaults(spark):
    rows = [(0, f, 1, 60, 60, f + 1) for f in range(30)] + [(0, f, -1, 60, 60, None) for f in range(3)] + [(0, 5, 2, 10, 60, 1), (0, 6, 2, 60, 60, 2)]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, track_id long, width int, height int, history int")
    sent = lambda out: sorted((r.track_id, r.frame_index) for r in out.collect())
    assert sent(M.first_per_track(df)) == [(-1, 0), (-1, 1), (-1, 2), (1, 0), (2, 6)]
    assert sent(M.first_per_track(df, only_for_tracked=True)) == [(1, 24)]


def test_near_matches_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    v = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.2, 0.4)])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = np.sqrt(np.maximum(0, 2 - 2 * unit @ unit.T))
    want = {(a, b) for a, b in itertools.combinations(range(len(v)), 2) if far[a, b] <= 0.8}
    got = {(r.id_a, r.id_b) for r in E.match_near(df, df, 0.8).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100


def test_projection_is_on_the_principal_components(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 8)) * np.arange(8, 0, -1)
    got = E.project_2d(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")).orderBy("vec_id").toPandas()
    _, _, axes = np.linalg.svd(v - v.mean(0), full_matrices=False)
    for name, axis in (("px", axes[0]), ("py", axes[1])):
        assert abs(np.corrcoef(got[name], v @ axis)[0, 1]) > 0.999999 and 0 <= got[name].min() and got[name].max() <= 1
    assert E.project_2d(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0


def test_update_merges_masks_sub_targets_and_more(spark):
    kind = "channel_index int, frame_index int, target_no int, track_id long, secondary array<string>, embedding array<double>, mask string, sub_targets array<struct<label:string>>, own int"
    a = spark.createDataFrame([(0, 0, 0, -1, ["a"], None, None, [("p",)], 1), (0, 0, 1, 4, None, [1.0], "m", None, 2), (0, 1, 0, -1, [], [], "", [], 3)], kind)
    b = spark.createDataFrame([(0, 0, 0, 9, ["b"], [2.0], "n", [("q",)], 7), (0, 0, 1, 8, ["c"], [3.0], "n", None, 8), (0, 1, 0, 5, ["d"], [4.0], "n", [], 9), (0, 1, 1, 6, ["e"], [5.0], "n", [], 9)], kind)
    got = {(r.frame_index, r.target_no): tuple(r)[3:] for r in W.sync_update(a, b).collect()}
    assert got[0, 0] == (9, ["a", "b"], [2.0], "n", [("p",), ("q",)], 1) and got[0, 1] == (4, ["c"], [1.0], "m", [], 2)
    assert got[1, 0] == (-1, [], [], "", [], 3)  # frames with other numbers of targets stay


def test_small_and_large_sides_join_alike(spark):
    rows, small = spark.range(100).selectExpr("id", "id % 7 as k"), spark.range(5).selectExpr("id as k", "id * 10 as v")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few, many = J.join_small(rows, small, "k", "left"), J.join_small(rows, small, "k", "left", limit=4)
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)


def test_sizes_and_ids(spark):
    rows = [(0, k, k, "a", 10 * k, 50) for k in range(6)]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, vec_id long, label string, width int, height int")
    assert [r.vec_id for r in E.label_gallery(df, 2, min_width=10, min_height=50).orderBy("rank").collect()] == [5, 4]
    events = spark.createDataFrame([(0, 2, B.JAM, [4, 5]), (0, 4, B.UNJAM, [4])], "channel_index int, frame_index int, ba_type int, target_ids array<long>")
    got = B.jam_status(events, frames(spark, 6)).orderBy("frame_index").collect()
    assert [r.jammed for r in got] == [False, False, True, True, False, False] and got[0].target_ids is None and got[3].target_ids == [4, 5] and got[4].target_ids == [4]


def test_callbacks(spark):
    seen = []
    U.on_results(spark.range(3), lambda df, batch: seen.append((batch, df.count())))
    assert seen == [(0, 3)]


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 6, 2))
        cost, k = rng.random((n, m)), min(n, m)
        best = min(sum(cost[i, j] for i, j in zip(r, c)) for r in itertools.permutations(range(n), k) for c in itertools.combinations(range(m), k))
        assert abs(sum(cost[i, j] for i, j in T.assign(cost)) - best) < 1e-9
        like = cost * (rng.random((n, m)) < 0.5)
        most = max(sum(like[i, j] for i, j in zip(r, c)) for r in itertools.permutations(range(n), k) for c in itertools.combinations(range(m), k))
        assert abs(sum(like[i, j] for i, j in T.match(like)) - most) < 1e-9


def test_first_seen_identities(spark):
    e = np.eye(4)
    rows = [(0, k, k, v.tolist()) for k, v in enumerate([e[0], e[0], e[1], e[1] + 0.01, e[2], e[0] + 0.02])]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in E.first_seen_identities(df, 2).collect()) == [2, 4]


def test_search_in_blocks(spark, monkeypatch):
    v = X.vectors(spark, "/root/testdata/sf0.001")
    key = ["probe_id", "rank", "vec_id", "cosine"]
    once = sorted(map(tuple, E.search_topk(v.where("vec_id < 20"), v, 3).select(*key).collect()))
    monkeypatch.setattr(E, "PROBE_BLOCK", 7)
    assert sorted(map(tuple, E.search_topk(v.where("vec_id < 20"), v, 3).select(*key).collect())) == once


def test_text_helpers(spark):
    row = spark.range(1).select(
        TX.split_tokens(F.lit("a,,b,"), ",").alias("a"), TX.round_any(F.lit(2.345), 2).alias("b"), TX.round_any(F.lit(3.0), 2).alias("c"), TX.pad_left(F.lit("12345"), 3).alias("d"), TX.pad_left(F.lit("7"), 3).alias("e"),
        TX.time_format(F.lit("2024-03-04 05:06:07.089").cast("timestamp"), "<year>-<mon>-<day>T<hour>", "Asia/Shanghai").alias("f"),
    ).first()
    assert tuple(row) == (["a", "", "b"], "2.35", "3", "12345", "007", "2024-03-04T13")


def test_images_and_bounds(spark, tmp_path):
    for k in (3, 12):
        (tmp_path / f"img_{k:03d}.jpg").write_bytes(b"x" * k)
    assert sorted((r.frame_index, r.length) for r in S.read_images(spark, str(tmp_path)).collect()) == [(3, 3), (12, 12)]
    for wrong in (lambda: S.sample_frames(frames(spark, 1), 10), lambda: S.sample_every(frames(spark, 1), 0), lambda: S.resize(frames(spark, 1), 1.5), lambda: R.file_segments(frames(spark, 1), 31)):
        with pytest.raises(ValueError):
            wrong()


def test_write_messages(spark, tmp_path):
    S.write_messages(spark.range(3).selectExpr("cast(id as string) as message"), "text", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
