"""What the findings of round 3 named."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Window, functions as F

from vidlake import fixtures as X
from vidlake.functions.geometry import point_in_polygon
from vidlake.operators import behaviour as B, embed as E, flow as W, index as I, messages as M, models as U, track as T
from vidlake.operators.ordered import busy_frames
from vidlake.plans import behaviour as PB, catalog, decode as PD, embed as PE, flow as PF

SF = "/root/testdata/sf0.001"


def test_detections_are_many_tasks(spark, monkeypatch):
    whole = X.detections(spark, SF).count()
    monkeypatch.setattr(X, "TASK_ORDERS", 500)
    rows = X.detections(spark, SF)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == whole


def test_model_results_leave_together_and_batches_stay(spark):
    def sizes(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(rows)] * len(rows)})

    one = spark.range(1000, numPartitions=1)
    assert sorted(r.n for r in U.apply_model(one, sizes, "n long").collect()) == sorted([32] * 992 + [8] * 8)
    assert [len(r) for r in U._together(sizes(pd.DataFrame(index=range(k))) for k in (2, 3))] == [5]
    # other types are not changed by what stands beside them
    mixed = [pd.DataFrame({"n": [2**60 + 1]}), pd.DataFrame({"n": [np.nan]})]
    assert [r["n"].dtype.kind for r in U._together(mixed)] == ["i", "f"]


def test_numbers_of_messages_are_rounded_by_their_exact_value(spark):
    values = [17 / 128, 127 / 128, 0.1234565, 1e-5, 123456.5, 1234565.0, 0.0, -0.5, 100.0, 9.9999995]
    df = spark.createDataFrame([(0, 0, 0, 1, [*values, None], ["c1"], "x")], "channel_index int, frame_index int, target_no int, track_id long, embedding array<double>, secondary array<string>, sub_label string")
    said = duckdb.execute("select array_to_string(list_transform(?::double[], lambda x: printf('%.6g', x)), ',')", [values]).fetchall()[0][0]
    assert M.embedding_messages(df, "crops").first().message.split("\n")[2] == said
    assert M.property_messages(df, "crops").first().message.split("\n")[2] == said


def test_sql_of_first_seen_forgets_as_the_operator_does(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 8))[rng.integers(0, 40, 300)]
    table = pa.table({"vec_id": np.arange(300) * 4, "embedding": pa.array(v.tolist(), pa.list_(pa.float64())), "label": np.zeros(300, np.int32)})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    for most in (3, 1000):
        want = {r[0] for r in con.execute(f"with recursive {PE._seen(most)} select vec_id from walk where fresh").fetchall()}
        got = {r.vec_id for r in E.first_seen_identities(X.vectors(spark, str(tmp_path)), 2, most).collect()}
        assert got == want and got


def test_match_near_finds_all_pairs_and_shuffles_none(spark, monkeypatch):
    monkeypatch.setattr(E, "NEAR_ROWS", 100)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(500, 16))
    v[7] = 0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    far = np.linalg.norm(u[:, None] - u[None], axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(far <= 1.1)) if i < j}
    got = E.match_near(df, df, 1.1).collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.l2 - far[r.id_a, r.id_b]) < 2e-6 for r in got)


def test_tracked_frames_leave_in_batches(spark, monkeypatch):
    # a task's output batches are counted by what mapInPandas hands to Spark
    class Rows:
        columns = ["channel_index", "frame_index", "x", "y", "width", "height"]
        schema = []

        def __init__(self):
            self.drop = self.repartition = self.sortWithinPartitions = lambda *_: self

        def mapInPandas(self, run, _):
            frame = lambda c, f: pd.DataFrame({"channel_index": c, "frame_index": f, "x": [10 * k for k in range(3)], "y": 5, "width": 8, "height": 8})
            rows = pd.concat([frame(c, f) for c in (0, 1) for f in range(50)], ignore_index=True)
            return list(run(iter([rows.iloc[:100], rows.iloc[100:]])))

    out = T.sort_track(Rows(), 2)
    assert len(out) == 3  # two batches and the last frame
    whole = pd.concat(out)
    assert len(whole) == 300 and whole.groupby(["channel_index", "x"])["track_id"].max().tolist() == [1, 2, 3] * 2


def test_vectors_of_cells_leave_in_batches_and_no_pair_is_lost(spark, monkeypatch):
    class Shared:
        value = None

    rng = np.random.default_rng(9)
    v = E.unit_rows(pa.array(rng.normal(size=(600, 8)).tolist()))
    v[300:] = E.unit_rows(pa.array((v[:300] + rng.normal(scale=0.03, size=(300, 8))).tolist()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), pa.array(v.tolist())], names=["vec_id", "embedding"])
    monkeypatch.setattr(I, "CELL_ROWS", 100)
    Shared.value = (v[:40], np.zeros(40), np.full(40, 2.0))
    sent = list(I._to_cells(Shared, 0.2)([batch]))
    # one batch went to every near cell at once before
    assert len(sent) > 6 and max(len(b) for b in sent) <= 100
    far = np.linalg.norm(v[:, None] - v[None], axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(far <= 0.2)) if i < j}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = I.match_within(df, df, 0.2, pivots=40).collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want) >= 250


def test_windows_by_track_do_not_shuffle_detections(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_ORDERS", 300)
    order = Window.partitionBy("channel_index", "track_id").orderBy("frame_index")
    plan = X.detections(spark, SF).withColumn("n", F.row_number().over(order))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(channel_index") == 1  # the groups' own; two before


def test_busy_frames_are_the_distinct_frames(spark):
    rows = [(c, f) for c in (0, 1, None) for f in (-130, -64, -1, 0, 63, 64, 64, 5000, None)]
    df = spark.createDataFrame(rows, "channel_index int, frame_index int")
    got = busy_frames(df)
    assert got.schema["frame_index"].dataType == df.schema["frame_index"].dataType
    assert sorted(map(str, got.collect())) == sorted(map(str, df.where("frame_index is not null").distinct().collect()))
    # whole tracks are handed on as words
    whole = spark.range(64 * 50).selectExpr("0 as channel_index", "cast(id as int) as frame_index")
    assert busy_frames(whole).count() == 3200


def test_runs_by_stretches_are_the_runs_by_frames(spark, monkeypatch):
    rng = np.random.default_rng(11)
    listed = {c: sorted(rng.choice(200, 150 + 40 * c, replace=False).tolist()) for c in (0, 1)}
    hits = {(c, t): sorted({f for s in rng.integers(0, 200, 6) for f in range(s, min(200, s + 25))}) for c in (0, 1) for t in range(8)}
    stops, counts = set(), {(c, f): 0 for c in listed for f in listed[c]}
    for (c, t), own in hits.items():
        run = 0
        for f in listed[c]:
            if f in own:
                run += 1
                stops |= {(c, f, 2, t)} if run == 10 else set()
                counts[c, f] += run >= 10
            else:
                stops |= {(c, f, 4, t)} if run >= 10 else set()
                run = 0
    frames = spark.createDataFrame([(c, f, 25) for c in listed for f in listed[c]], "channel_index int, frame_index int, fps int")
    df = spark.createDataFrame([(c, t, f) for (c, t), own in hits.items() for f in own], "channel_index int, track_id long, frame_index int")
    got = B.stop_events(df, frames, 10).collect()
    assert {(r.channel_index, r.frame_index, r.ba_type, r.track_id) for r in got} == stops and len(got) == len(stops)
    monkeypatch.setattr(B, "stop_hits", lambda history, *_: history)
    assert {(r.channel_index, r.frame_index): r.stops for r in B.jam_counts(df, None, frames, 10).collect()} == counts
    # frames meet ends of stretches, of which there are few
    every = spark.range(200).selectExpr("explode(array(0, 1)) as channel_index", "cast(id as int) as frame_index")
    assert 0 < B._runs(df, B.frame_ordinals(every)).count() < df.count() // 5


def test_first_per_track_keeps_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_ORDERS", 100)
    # some 15 tasks by the orders, not the session's 4 partitions
    assert PD.QUERIES["first_per_track"](spark, SF).rdd.getNumPartitions() == 16


def test_decoding_sorts_numbers_and_no_lists(spark):
    query = PD.QUERIES["label_lookup"](spark, SF)._jdf.queryExecution()
    nodes = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query, "formatted").split("\n\n")
    sorts = [n for n in nodes if ") Sort" in n and "Input [" in n]
    assert sorts and not [n for n in sorts if "values" in n or "scores" in n]


def test_detector_rows_are_dealt_by_frame(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_ROWS", 500)
    rows = X.raw_rows(spark, SF)
    tasks = 1 + X.read(spark, SF, "lineitem").count() // 500
    assert rows.rdd.getNumPartitions() == tasks > 4
    assert PD.QUERIES["decode_yolo"](spark, SF).rdd.getNumPartitions() == tasks


def test_search_holds_small_tiles():
    class Shared:
        value = np.arange(3000), E.unit_rows(pa.array(np.random.default_rng(1).normal(size=(3000, 8)).tolist()))

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(Shared.value[1].tolist())], names=["vec_id", "embedding"])
    tracemalloc.start()
    found = list(E._best(Shared, 5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 15000 and peak < 80 << 20  # 130 MB or more before


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]


def test_targets_of_frames_are_shuffled_once_and_narrow(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_ORDERS", 300)
    # its own shuffle by frame, and those of the tracks and groups that it is made of; lists and joined rows were shuffled before
    for query, branches in ((PD.QUERIES["json_all_fields"], 3), (PF.QUERIES["sync_update"], 2)):
        found = _exchanges(query(spark, SF))
        assert len([e for e in found if "REPARTITION_BY_NUM" in e and "frame_index" in e]) == branches
        assert not [e for e in found if "ENSURE_REQUIREMENTS" in e and "frame_index" in e]


def test_parts_and_branches_beside_targets_keep_the_results_of_joins(spark):
    t = spark.createDataFrame([(0, 1, 0, "a"), (0, 1, 0, "b"), (0, 1, 1, "c"), (0, 2, None, "d"), (None, 2, 0, "e")], "channel_index int, frame_index int, target_no int, tag string")
    p = spark.createDataFrame([(0, 1, 0, k, 9 - k) for k in (2, 0, 1)] + [(0, 2, None, 0, 1), (None, 2, 0, 0, 1), (0, 9, 0, 0, 1)], "channel_index int, frame_index int, target_no int, part_no int, x int")
    got = {r.tag: [s.x for s in r.sub_targets] for r in M.with_sub_targets(t, p).collect()}
    assert got == {"a": [9, 8, 7], "b": [9, 8, 7], "c": [], "d": [], "e": []}
    kind = "channel_index int, frame_index int, target_no int, track_id long, secondary array<string>"
    a = spark.createDataFrame([(0, 1, 0, -1, ["x"]), (0, 1, 1, 5, None), (0, 2, 0, -1, ["x"]), (0, 3, 0, -1, ["x"]), (None, 1, 0, -1, ["n"]), (0, 4, None, -1, []), (0, 5, 0, -1, []), (0, 5, 1, -1, [])], kind)
    b = spark.createDataFrame([(0, 1, 0, 7, ["y"]), (0, 1, 1, 8, ["z"]), (0, 2, 0, 7, ["y"]), (0, 2, 1, 8, ["y"]), (None, 1, 0, 9, ["n"]), (0, 4, None, 9, ["m"]), (0, 5, 0, 3, ["p"]), (0, 5, 0, 4, ["q"])], kind)
    got = sorted(map(str, W.sync_update(a, b).collect()))
    want = [(0, 1, 0, 7, ["x", "y"]), (0, 1, 1, 5, ["z"]), (0, 2, 0, -1, ["x"]), (0, 3, 0, -1, ["x"]), (None, 1, 0, -1, ["n"]), (0, 4, None, -1, []), (0, 5, 0, 3, ["p"]), (0, 5, 0, 4, ["q"]), (0, 5, 1, -1, [])]
    assert got == sorted(map(str, spark.createDataFrame(want, kind).collect()))


def test_spelled_out_edges_are_the_polygon(spark):
    rng = np.random.default_rng(4)
    rings = [[tuple(map(int, q)) for q in rng.integers(-20, 20, (n, 2))] for n in (1, 2, 3, 4, 7)] + [None, [(0, 0), None, (9, 9), (0, 9)]]
    points = [tuple(map(int, q)) for q in rng.integers(-22, 22, (60, 2))]
    df = spark.createDataFrame([(q, r) for q in points for r in rings], "p struct<x: int, y: int>, ring array<struct<x: int, y: int>>")
    both = df.select(point_in_polygon(F.col("p"), F.col("ring")).alias("a"), point_in_polygon(F.col("p"), F.col("ring"), 7).alias("b")).collect()
    assert all(r.a == r.b for r in both) and {True, False, None} == {r.a for r in both}
    plan = PB.QUERIES["stop_hits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan


def test_history_is_dealt_as_its_targets(spark, monkeypatch):
    # fewer tasks than the session's partitions: the wide rows were shuffled into those before
    monkeypatch.setattr(X, "TASK_ORDERS", 600)
    tasks = X.tasks(spark, SF)
    assert 1 < tasks < 4
    for name in ("first_per_track", "track_trail"):
        wide = [e for e in _exchanges(catalog.QUERIES[name](spark, SF)) if "track_id" in e]
        assert wide and all("REPARTITION_BY_NUM" in e for e in wide)
    targets = X.detections(spark, SF)
    whole, dealt = T.track_history(targets), T.track_history(targets, tasks, busy_frames(targets))
    assert whole.exceptAll(dealt).isEmpty() and whole.count() == dealt.count()
    assert dealt.where("seg > 0").count() > 0


def test_hits_of_a_frame_count_once_for_runs(spark):
    frames = spark.range(120).selectExpr("0 as channel_index", "cast(id as int) as frame_index", "25 as fps")
    hits = frames.selectExpr("channel_index", "frame_index", "7L as track_id").where("frame_index between 10 and 70")
    want = {(r.frame_index, r.ba_type) for r in B.stop_events(hits, frames).collect()}
    assert want == {(59, B.STOP), (71, B.UNSTOP)}
    # a row each more on some frames, as stop_hits leaves them with once=False
    more = hits.unionByName(hits.where("frame_index % 3 = 0"))
    assert {(r.frame_index, r.ba_type) for r in B.stop_events(more, frames).collect()} == want


def test_detections_of_a_task_are_in_order_of_track_and_frame(spark):
    parts = X.detections(spark, SF).select("track_id", "frame_index").rdd.glom().collect()
    assert all(rows == sorted(rows) for rows in parts)


def test_only_targets_of_events_go_on(spark):
    targets = spark.range(600).selectExpr("0 as channel_index", "cast(id div 6 as int) as frame_index", "id % 6 as track_id").repartition(3, "channel_index", "track_id")
    ids = spark.createDataFrame([(1, 0, f, t) for f, t in ((3, 1), (3, 2), (50, 1), (200, 1), (4, 9))], "event_no long, channel_index int, frame_index int, track_id long")
    # all 200 rows of tracks 1 and 2 before
    out = M._meant(targets, ids, 3)
    assert sorted((r.frame_index, r.track_id) for r in out.collect()) == [(3, 1), (3, 2), (50, 1)]
