"""Operators whose work is cut across channels, lists, cells and blocks, against plain versions."""

import logging
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vidlake import fixtures as X
from vidlake.operators import embed as E, index as I, joins as J, messages as M, metrics, models as U, ordered as O
from vidlake.sources import frames as S

SF = "/root/testdata/sf0.001"


def vectors(spark, rows, start=0):
    return spark.createDataFrame([(k + start, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def gathered():
    """Vectors around 40 places; a third of all in one of them."""
    rng = np.random.default_rng(3)
    places = rng.normal(size=(40, 16))
    which = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 40, 1500))
    return places[which] + rng.normal(size=(1500, 16)) * 0.15


# ---- order over ranges ----


def test_numbers_and_neighbours_over_ranges(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.05 else int(rng.random() ** 3 * 5), rng.randrange(50), k, rng.choice("abc")) for k in range(900)]
    df = spark.createDataFrame(rows, "channel_index int, at int, id int, state string").repartition(3)
    place, before = {}, {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2]))
        for k, r in enumerate(own):
            place[r[2]], before[r[2]] = k, own[k - 1][3] if k else None
    got = O.numbered(df, ["channel_index"], ["at", "id"], "n", 7)
    assert {r.id: r.n for r in got.collect()} == place and got.columns == [*df.columns, "n"]
    got = O.previous(df, ["channel_index"], ["at", "id"], F.col("state"), "was", 7)
    assert {r.id: r.was for r in got.collect()} == before


def test_one_channel_is_many_ranges(spark):
    df = spark.range(4000).selectExpr("0 as channel_index", "id")
    assert O.in_ranges(df, ["channel_index"], ["id"], 8).select(O.RANGE).distinct().count() == 8
    got = S.number_frames(df, ["id"])
    assert got.where("frame_index <> id").count() == 0 and got.count() == 4000


def test_source_info_tells_changes(spark):
    rows = [(0, 0, 25, "a"), (0, 1, 25, "a"), (0, 2, 30, "a"), (0, 3, 25, "a"), (1, 5, 25, "b")]
    df = spark.createDataFrame([(c, f, fps, 8, 7, u) for c, f, fps, u in rows], "channel_index int, frame_index int, fps int, width int, height int, uri string")
    got = {(r.channel_index, r.since_frame, r.original_fps, r.original_width, r.uri) for r in S.source_info(df).collect()}
    assert got == {(0, 0, 25, 8, "a"), (0, 2, 30, 8, "a"), (0, 3, 25, 8, "a"), (1, 5, 25, 8, "b")}


# ---- matching in rounds ----


def test_first_of_both_is_the_ordered_matching(spark, caplog):
    rng = random.Random(8)
    rows = list({(rng.randrange(2), rng.randrange(200), rng.randrange(30), f"t{int(rng.random() ** 3 * 25)}") for _ in range(500)})
    rows += [(5, k, k // 2, f"c{(k + 1) // 2}") for k in range(12)]  # a chain, each of whose rows waits for the one before
    rows += [(6, k, k, "hot") for k in range(300)]  # a text of very many tracks
    want = set()
    for g in {r[0] for r in rows}:
        tracks, texts = set(), set()
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2], r[3])):
            if r[2] not in tracks and r[3] not in texts:
                tracks.add(r[2])
                texts.add(r[3])
                want.add(r)
    df = spark.createDataFrame(rows, "g int, frame int, track int, text string")
    with caplog.at_level(logging.INFO, "vidlake.operators.messages"):
        got = M.first_of_both(df, "g", "track", "text", ["frame", "track", "text"])
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert "rounds" in caplog.text
    assert M.first_of_both(df.limit(0), "g", "track", "text", ["frame", "track", "text"]).count() == 0


def test_first_per_plate_runs_no_python(spark):
    rows = [(0, k, k, 120, 40, f"blue_A12345{k % 3}") for k in range(9)]
    out = M.first_per_plate(spark.createDataFrame(rows, "channel_index int, frame_index int, track_id long, width int, height int, label string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3 and "Python" not in plan and "Pandas" not in plan


# ---- search and matching of vectors ----


def exact_top(gallery, probes, k):
    near = unit(probes) @ unit(gallery).T
    return [set(np.lexsort((np.arange(len(gallery)), -row.round(6)))[:k].tolist()) for row in near]


def test_index_finds_what_is_near(spark, gathered):
    gallery = vectors(spark, gathered)
    index = I.build_index(gallery, lists=30, k=10, part_rows=100)
    assert index.postings.count() == 1500 and index.postings.select("vec_id").distinct().count() == 1500
    assert index.postings.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 250 and max(index.parts) > 1
    assert index.probes < 30
    asked = gallery.where("vec_id % 50 = 0")
    got = {}
    for r in I.search_index(index, asked, 10).collect():
        got.setdefault(r.probe_id, set()).add(r.vec_id)
    want = exact_top(gathered, gathered[::50], 10)
    assert np.mean([len(got[50 * k] & w) / 10 for k, w in enumerate(want)]) >= 0.9
    # with every list probed the result is that of the exact search
    every = {tuple(r) for r in I.search_index(index, asked, 10, lists=30).select("probe_id", "vec_id", "rank").collect()}
    assert every == {tuple(r) for r in E.search_topk(asked, gallery, 10).select("probe_id", "vec_id", "rank").collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_index_query_recall_over_all_rows(spark, sf):
    from vidlake.plans import embed as PE

    exact = {(r.probe_id, r.vec_id) for r in PE.search_topk(spark, f"/root/testdata/{sf}").collect()}
    found = {(r.probe_id, r.vec_id) for r in PE.search_index(spark, f"/root/testdata/{sf}").collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_index_blocks_of_probes(spark, gathered, monkeypatch):
    gallery = vectors(spark, gathered[:300])
    index = I.build_index(gallery, lists=8, k=3)
    whole = {tuple(r) for r in I.search_index(index, gallery, 3).select("probe_id", "vec_id", "rank").collect()}
    monkeypatch.setattr(I, "PROBE_BLOCK", 90)
    monkeypatch.setattr(I, "TILE_CELLS", 500)
    assert {tuple(r) for r in I.search_index(index, gallery, 3).select("probe_id", "vec_id", "rank").collect()} == whole


@pytest.mark.parametrize("max_l2", [0.25, 0.8])
def test_pivots_miss_nothing(spark, gathered, max_l2):
    v = vectors(spark, gathered)
    compared = spark.sparkContext.accumulator(0)
    got = I.match_within(v, v, max_l2, part_rows=150, compared=compared).collect()
    near = unit(gathered) @ unit(gathered).T
    a, b = np.nonzero(np.triu(near >= 1 - max_l2**2 / 2, 1))
    assert sorted((r.id_a, r.id_b) for r in got) == list(zip(a.tolist(), b.tolist())) and len(got) > 50
    if max_l2 < 0.5:
        assert 0 < compared.value < 0.35 * 1500 * 1500, "most pairs are not compared"


def test_pivots_of_two_tables_and_of_none(spark, gathered):
    a, b = vectors(spark, gathered[:200]), vectors(spark, gathered[200:500], 200)
    got = {(r.id_a, r.id_b) for r in I.match_within(a, b, 0.4).collect()}
    near = unit(gathered[:200]) @ unit(gathered[200:500]).T
    assert got == {(int(i), int(j) + 200) for i, j in zip(*np.nonzero(near >= 1 - 0.4**2 / 2))}
    assert I.match_within(a.limit(0), b, 0.4).count() == 0 and I.match_within(a, b.limit(0), 0.4).count() == 0


# ---- identities in blocks ----


def plain_identities(rows, most):
    out = set()
    for c in {r[0] for r in rows}:
        base, known = None, []
        for _, _, vec, e in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2])):
            v = np.array(e) / np.linalg.norm(e)
            if base is None:
                base = v
                continue
            like = np.array([base, *known]) @ v
            if like.max() < E.SAME_COSINE and np.sqrt(2 - 2 * like.max()) > E.SAME_L2:
                known = [*known, v][-most:]
                out.add((c, vec, round(float(like[0]), 6)))
    return out


@pytest.mark.parametrize("most", [1000, 12])
def test_identities_in_blocks(spark, most):
    rng = np.random.default_rng(4)
    rows = []
    for c, n in ((0, 700), (1, 90), (2, 1)):
        people = rng.normal(size=(60, 12))
        # those who come back, and those who come late
        for k in range(n):
            who = int(rng.integers(0, 1 + min(59, k // 8)))
            rows.append((c, k // 3, len(rows), (people[who] + rng.normal(size=12) * 0.2).tolist()))
    df = spark.createDataFrame(rows, "channel_index int, frame_index int, vec_id long, embedding array<double>").repartition(3)
    want = plain_identities(rows, most)
    for first_block in (25, 5000):
        got = {(r.channel_index, r.vec_id, r.cosine) for r in E.first_seen_identities(df, 4, most, first_block, part_rows=20).collect()}
        assert got == want and len(want) > 20


def test_identities_of_nothing(spark):
    df = spark.createDataFrame([], "channel_index int, frame_index int, vec_id long, embedding array<double>")
    assert E.first_seen_identities(df, 4).collect() == []


# ---- metrics ----


def test_sketch_is_within_its_error(spark):
    rng = np.random.default_rng(5)
    ms = np.concatenate([rng.lognormal(3, 1.5, 3000).round(3), [0.0] * 40])
    rows = [(k % 2, 0, k, float(m)) for k, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "channel_index int, h int, k int, ms double")
    start = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("k").cast("long") * 4_000_000)
    df = df.select("channel_index", start.alias("in_time"), F.timestamp_micros(F.unix_micros(start) + F.round(F.col("ms") * 1000).cast("long")).alias("out_time"))
    hours = metrics.latency_sketch(df, 3_600_000)
    days = metrics.sketch_latency(metrics.rolled_up(hours, 86_400_000)).collect()
    whole = {r.channel_index: r for r in metrics.sketch_latency(metrics.rolled_up(hours, 1 << 50)).collect()}
    assert len(days) >= 2 and hours.count() < 2500
    for c in (0, 1):
        own = np.sort(ms[c::2])
        exact = own[int(np.ceil(0.95 * len(own))) - 1]
        assert abs(whole[c].p95_ms - exact) <= metrics.SKETCH_ERROR * exact * 1.001
        assert whole[c].max_ms == pytest.approx(own[-1]) and whole[c].avg_ms == pytest.approx(own.mean(), abs=1e-5)


def test_stale_stretches(spark):
    rows = [("a", s) for s in (0, 3, 5.5, 20, 24.9)] + [("b", 1)]
    df = spark.createDataFrame([(n, "in", float(s)) for n, s in rows], "node string, port string, s double").withColumn("in_time", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    at = lambda c: F.unix_millis(c)
    got = {tuple(r) for r in metrics.stale_ports(df).select("node", at("active_from"), at("stale_from"), at("active_again"), "events").collect()}
    assert got == {("a", 0, 10500, 20000, 3), ("a", 20000, 29900, None, 2), ("b", 1000, 6000, None, 1)}


# ---- messages, sinks, models ----


def test_fields_of_each_kind(spark):
    frames = spark.createDataFrame([(0, 1, 25, 8, 7)], "channel_index int, frame_index int, fps int, width int, height int")
    faces = spark.createDataFrame([(0, 1, 1, 3, 4, 5, 6, 0.5, [0.25])], "channel_index int, frame_index int, target_no int, x int, y int, width int, height int, score double, embeddings array<double>")
    got = M.kind_messages(frames, faces, "face").first().message
    assert got == '{"channel_index":0,"frame_index":1,"width":8,"height":7,"fps":25,"broke_for":"face","face_size":1,"face_targets":[{"x":3,"y":4,"width":5,"height":6,"score":0.5,"embeddings":[0.25],"key_points":[],"track_id":-1}]}'
    texts = spark.createDataFrame([(0, 1, k, t, 0.5) for k, t in ((2, "b"), (1, "a"))], "channel_index int, frame_index int, target_no int, text string, score double")
    got = M.kind_messages(frames, texts, "text").first().message
    assert got.endswith('"text_size":2,"text_targets":[{"text":"a","score":0.5,"region":[],"flags":""},{"text":"b","score":0.5,"region":[],"flags":""}]}')
    xml = M.kind_messages(frames, texts, "text", xml=True).first().message
    assert xml.startswith("<message>") and xml.count("<text_targets>") == 2 and "<broke_for>text</broke_for>" in xml


def test_a_failing_batch_leaves_no_row_twice(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, place, calls = str(tmp_path / "out"), str(tmp_path / "c"), []

    def keep(df, batch):
        calls.append(batch)
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if batch == 1 and calls.count(1) == 1:
            raise RuntimeError("cut off after writing")

    def start():
        q = source().writeStream.foreachBatch(U.once_each(keep, f"{place}/ledger")).option("checkpointLocation", place).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:
            return False
        return q.exception() is None

    assert not start() and start() and start()
    assert calls == [0, 1, 1, 2] and sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))
    # a batch in the ledger is not given again, though the stream has lost that it was done
    done = U.once_each(keep, f"{place}/ledger")
    done(spark.range(5), 2)
    assert calls == [0, 1, 1, 2]


def test_write_once(spark, tmp_path):
    spark.range(20).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = U.write_once(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        return 3

    out = U.apply_loaded_model(spark.range(0, 400, 1, 4), "times three", load, lambda m, b: pd.DataFrame({"id": b["id"], "y": b["id"] * m}), "id long, y long", batch_size=16)
    for _ in range(2):
        assert out.where("y <> id * 3").count() == 0 and out.count() == 400
    loads = open(f"{folder}/loads").read().split()
    assert len(loads) == len(set(loads)) <= 8


def test_small_side_is_judged_by_its_bytes(spark):
    rows, small = spark.range(100).selectExpr("id % 5 as k"), spark.range(5).selectExpr("id as k", "repeat('x', 1000) as v")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few, large = J.join_small(rows, small, "k"), J.join_small(rows, small, "k", most_bytes=100)
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(large)
    assert few.count() == large.count() == 100


def test_sketch_and_rollup_on_events(spark):
    exact = {(r.channel_index, r.epoch_ms): r for r in metrics.latency(X.trace(spark, SF), 86_400_000).collect()}
    got = metrics.sketch_latency(metrics.latency_sketch(X.trace(spark, SF), 86_400_000)).collect()
    assert len(got) == len(exact) and all(r.avg_ms == pytest.approx(exact[r.channel_index, r.epoch_ms].avg_ms, abs=1e-5) for r in got)


def test_recall_of_match_near_over_all_rows(spark):
    """The pairs of the approximate join among those of the exact one, for every vector of the table; what it finds is right."""
    v = X.vectors(spark, "/root/testdata/sf0.01").select("vec_id", "embedding")
    exact = {(r.id_a, r.id_b) for r in I.match_within(v, v, 1.25).collect()}
    found = {(r.id_a, r.id_b) for r in E.match_near(v, v, 1.25).collect()}
    assert len(exact) > 1000 and found <= exact and len(found) >= 0.9 * len(exact)
