"""What the findings of round 4 named."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vidlake import fixtures as X
from vidlake.operators import behaviour as B, embed as E, messages as M, track as T
from vidlake.plans import decode as PD

SF = "/root/testdata/sf0.001"


def test_stopped_now_names_the_stopped_tracks_of_every_frame(spark):
    rng = np.random.default_rng(21)
    listed = {c: sorted(rng.choice(np.arange(-100, 500), 400, replace=False).tolist()) for c in (0, 1)}
    events, want = [(0, listed[0][5], B.JAM, 3)], {}
    for c in listed:
        on = {}
        for t in range(9):
            at = sorted(rng.choice(400, 5, replace=False).tolist())  # the last stop stays open
            events += [(c, listed[c][k], B.UNSTOP if n % 2 else B.STOP, t) for n, k in enumerate(at)]
            on[t] = [range(at[0], at[1]), range(at[2], at[3]), range(at[4], 400)]
        for k, f in enumerate(listed[c]):
            ids = [t for t in on if any(k in r for r in on[t])]
            want[c, f] = (ids, len(ids), sum(r.start <= k for rs in on.values() for r in rs))
    df = spark.createDataFrame(events, "channel_index int, frame_index int, ba_type int, track_id long")
    frames = spark.createDataFrame([(c, f) for c in listed for f in listed[c]], "channel_index int, frame_index int")
    got = B.stopped_now(df, frames).collect()
    assert {(r.channel_index, r.frame_index): (r.ids, r.stopped, r.stops) for r in got} == want and len(got) == len(want)


def _crowd(spark, frames):
    """Boxes of two channels that come, go, stand and meet; a few frames have none."""
    rng, rows = np.random.default_rng(13), []
    for c in (0, 1):
        for t in range(frames // 6):
            x, y, w, h = (int(v) for v in rng.integers((0, 0, 30, 30), (120, 120, 50, 50)))
            dx, dy = rng.integers(-2, 3, 2)
            rows += [(c, f, t, int(x + dx * k), int(y + dy * k), w, h) for k, f in enumerate(range(t * 6, t * 6 + int(rng.integers(5, 60)))) if rng.random() > 0.05 and f % 97]
    return spark.createDataFrame(rows, "channel_index int, frame_index int, target_no int, x int, y int, width int, height int")


def test_stretches_of_a_channel_give_the_ids_of_the_whole(spark, monkeypatch):
    df = _crowd(spark, 400)
    df = df.withColumn("x", F.when(F.expr("frame_index % 31 != 0 or target_no % 3 != 0"), F.col("x")))  # some boxes are not whole
    want = {tuple(r) for r in T.sort_track(df, 2).collect()}
    assert len({(r[0], r[-1]) for r in want}) > 40
    monkeypatch.setattr(T, "BLOCK", 10)
    tables, own = [], T.written
    monkeypatch.setattr(T, "written", lambda t, name: (tables.append(name), own(t, name))[1])
    # begun well, begun badly and mended side by side, and gone on in order
    for length, warm, again, rounds in ((100, 90, 3, None), (100, 20, 3, None), (40, 0, 1, 3), (40, 0, 0, 2)):
        monkeypatch.setattr(T, "STRETCH_FRAMES", length)
        monkeypatch.setattr(T, "WARM_FRAMES", warm)
        monkeypatch.setattr(T, "AGAIN", again)
        tables.clear()
        got = T.sort_track_stretches(df, 6).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        assert tables.count("tracked") == rounds or rounds is None
    # a channel was one task before
    monkeypatch.setattr(T, "WARM_FRAMES", 90)
    assert own(T._blocks(df), "blocks").select("channel_index", "_run").distinct().count() > 16


def test_covariances_are_five_numbers():
    rng, t, whole = np.random.default_rng(2), T.Trackers(), np.eye(7)
    move, look = np.eye(7) + np.diag([1.0] * 3, 4), np.eye(4, 7)
    t.step(np.array([[100, 100, 40, 40]]))
    for f in range(30):
        whole = move @ whole @ move.T + 0.01 * np.eye(7)
        if f % 7:
            whole = whole - whole @ look.T @ np.linalg.inv(look @ whole @ look.T + 0.1 * np.eye(4)) @ look @ whole
        t.step(np.array([[100 + int(rng.integers(0, 2)), 100, 40, 40]]) if f % 7 else np.zeros((0, 4), int))
        assert t.p.shape == (1, 7, 7) and np.allclose(t.p[0], whole, atol=1e-12)
        p = t.p
        t.p = p
        assert np.array_equal(t.p, p)


def test_match_near_sends_a_vector_once_a_block_and_results_tile_by_tile(spark, monkeypatch):
    monkeypatch.setattr(E, "NEAR_ROWS", 20)
    monkeypatch.setattr(E, "NEAR_BLOCKS", 5)
    monkeypatch.setattr(E, "NEAR_TILE", 16)
    rng = np.random.default_rng(6)
    v, ids = rng.normal(size=(300, 8)), rng.permutation(1000)[:300] - 500
    v[3] = 0
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    far = np.linalg.norm(u[:, None] - u[None], axis=2)
    kind = "vec_id long, embedding array<double>"
    a, b = (spark.createDataFrame([(int(ids[k]), v[k].tolist()) for k in part], kind) for part in (range(200), range(100, 300)))
    want = {(ids[i], ids[j]) for i in range(200) for j in range(100, 300) if ids[i] < ids[j] and far[i, j] <= 1.1}
    out = E.match_near(a, b, 1.1)
    got = out.collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want) > 1000
    # 5 blocks: 15 pairs of them; 10 blocks by 10 before, 100 pairs
    assert out.rdd.getNumPartitions() == 15
    with_null = a.unionByName(spark.createDataFrame([(None, [1.0] * 8)], kind))
    assert E.match_near(with_null, b, 1.1).count() == len(want) and E.match_near(a.limit(0), b.limit(0), 1.1).count() == 0
    # a task's results leave in batches no larger than a tile
    rows = pa.RecordBatch.from_arrays([pa.array([0] * 400, pa.int32()), pa.array([0] * 200 + [1] * 200, pa.int32()), pa.array(ids[list(range(200)) + list(range(100, 300))]), pa.array(v[list(range(200)) + list(range(100, 300))].tolist())], names=["meet", "side", "vec_id", "embedding"])
    sent = list(E._near(1.1)(iter([rows.slice(0, 150), rows.slice(150, 100), rows.slice(250)])))
    assert sum(map(len, sent)) == len(want) and max(map(len, sent)) <= 256


def test_targets_and_their_parts_share_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_ORDERS", 300)
    df = PD.QUERIES["json_all_fields"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    dealt = [line for line in plan if "Exchange hashpartitioning(frame_index" in line and "ReusedExchange" not in line]
    # targets, parts and frames were three wide shuffles before
    assert len(dealt) == 2 and [line for line in plan if "ReusedExchange" in line and "box" in line]


def test_messages_of_rows_that_are_dealt_by_stretch(spark):
    rng = np.random.default_rng(1)
    rows = [(c, f, t, int(rng.integers(0, 99))) for c in (0, 1) for f in range(0, 200, 7) for t in range(int(rng.integers(0, 4)))] + [(0, 7, None, 1), (None, 7, 0, 2), (0, None, 0, 3)]
    t = spark.createDataFrame(rows, "channel_index int, frame_index int, target_no int, x int").withColumn("near", F.shiftright("frame_index", 6))
    p = t.where("x % 2 = 0").withColumns({"part_no": F.explode(F.array(F.lit(1), F.lit(0)))})
    frames = spark.createDataFrame([(c, f, 800, 700, 25) for c in (0, 1) for f in [*range(0, 150, 7), 14, 3]], "channel_index int, frame_index int, width int, height int, fps int").withColumn("near", F.shiftright("frame_index", 6))
    plain = M.kind_messages(frames.drop("near"), M.with_sub_targets(t.drop("near"), p.drop("near")), "normal")
    near = M.kind_messages(frames, M.with_sub_targets(t, p, ["near"]), "normal", dealt=["near"])
    assert sorted(map(str, plain.collect())) == sorted(map(str, near.collect())) and plain.count() > 30
