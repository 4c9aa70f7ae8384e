"""Ordered per-channel operators as state: tracking, crossings, stops and jams, synchronising, first faces of a stream of frames.

Rows are (channel_index, frame_index, fps, track_id, x, y, width, height) with one row for a
frame without targets, whose track_id is null. All rows of a frame are in one
micro-batch; frames at or before the channel's last one are late and left out.

State lies in Spark's RocksDB store: a value a channel, and a map entry for each track,
tracker, identity or waiting frame. A micro-batch reads a channel's live entries, and
writes those that it changed and removes those that the operator forgets. With ttl_ms,
what has not been written for so long expires, so a channel that ends leaves nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vidlake.functions.text import parse_plate
from vidlake.operators import behaviour as B
from vidlake.operators.embed import SAME_COSINE, SAME_L2
from vidlake.operators.track import MAX_GAP, Trackers

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """The state of these operators needs the RocksDB store; another that the session has chosen is left to fail."""
    if "HDFSBacked" in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, ROCKSDB)


class ChannelState:
    """What an operator knows of one channel, between micro-batches in named maps.

    own: DDL of the channel's own values; maps: name -> (DDL of the key, DDL of the
    value). load gets the channel's values (None at first) and a dict a map, dump gives
    them back; values that are the same object as before are not written again.
    """

    own = "busy long"
    maps: dict[str, tuple[str, str]] = {}

    def load(self, own: tuple | None, maps: dict[str, dict]) -> None:
        raise NotImplementedError

    def dump(self) -> tuple[tuple, dict[str, dict]]:
        raise NotImplementedError


class ChannelFold(StatefulProcessor):
    """step(state, frame_index, rows of the frame) -> output rows, for every frame of a channel in order."""

    def __init__(self, start: Callable[[], ChannelState], step: Callable[[ChannelState, int, pd.DataFrame], list[tuple]], columns: list[str], ttl_ms: int | None):
        self.start, self.step, self.columns, self.ttl_ms = start, step, ["channel_index", "frame_index", *columns], ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = self.start()
        self.channel = handle.getValueState("channel", f"last long, {kind.own}", self.ttl_ms)
        self.maps = {name: handle.getMapState(name, key, value, self.ttl_ms) for name, (key, value) in kind.maps.items()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, kept = self.start(), {}
        last, *own = self.channel.get() or (-1, None)
        if own != [None]:
            kept = {name: dict(m.iterator()) for name, m in self.maps.items()}
        state.load(None if own == [None] else tuple(own), {name: {k[0]: v for k, v in kept.get(name, {}).items()} for name in self.maps})
        rows, out = pd.concat(list(rows)), []
        for frame, part in rows[rows["frame_index"] > last].sort_values("frame_index").groupby("frame_index", sort=True):
            out += [(key[0], frame, *r) for r in self.step(state, int(frame), part)]
            last = int(frame)
        own, maps = state.dump()
        self.channel.update((last, *own))
        for name, m in self.maps.items():
            was = kept.get(name, {})
            for k in was:
                if k[0] not in maps[name]:
                    m.removeKey(k)
            for k, v in maps[name].items():
                if was.get((k,)) is not v:
                    m.updateValue((k,), v)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def fold_channels(rows: DataFrame, start: Callable[[], ChannelState], step: Callable[[ChannelState, int, pd.DataFrame], list[tuple]], columns: list[str], schema: str, ttl_ms: int | None = None) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    fold = ChannelFold(start, step, columns, ttl_ms)
    return rows.groupBy("channel_index").transformWithStateInPandas(fold, f"channel_index int, frame_index int, {schema}", "append", "processingTime" if ttl_ms else "none")


class Following(ChannelState):
    """The live trackers, an entry each."""

    own = "next_id long"
    maps = {"trackers": ("id long", "x array<double>, p array<double>, age long, streak long")}

    def load(self, own, maps):
        t = self.trackers = Trackers()
        if own:
            t.next_id = own[0]
        live = sorted(maps["trackers"].items())
        if live:
            t.ids = np.array([k for k, _ in live], np.int64)
            t.x, t.p = np.array([v[0] for _, v in live], float), np.array([v[1] for _, v in live], float).reshape(-1, 7, 7)
            t.age, t.streak = (np.array([v[k] for _, v in live], np.int64) for k in (2, 3))

    def dump(self):
        t = self.trackers
        return (t.next_id,), {"trackers": {int(k): (x.tolist(), p.ravel().tolist(), int(a), int(s)) for k, x, p, a, s in zip(t.ids, t.x, t.p, t.age, t.streak)}}


def sort_track_stream(targets: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(channel_index, frame_index, target_no, track_id), as sort_track."""

    def step(state: Following, frame: int, rows: pd.DataFrame) -> list[tuple]:
        rows = rows.sort_values("target_no")
        ids = state.trackers.step(rows[["x", "y", "width", "height"]].to_numpy())
        return list(zip(rows["target_no"].tolist(), ids.tolist()))

    return fold_channels(targets, Following, step, ["target_no", "track_id"], "target_no int, track_id long", ttl_ms)


class Tracks(ChannelState):
    """Recent tracks of one channel: last frame and the last points of each, forgotten by the rule of track_history."""

    maps = {"tracks": ("track_id long", "last long, xs array<long>, ys array<long>")}
    keep = 2

    def load(self, own, maps):
        self.known = maps["tracks"]
        self.busy = own[0] if own else None

    def dump(self):
        return (self.busy,), {"tracks": self.known}

    def see(self, frame: int, rows: pd.DataFrame) -> dict[int, list[tuple[int, int]]]:
        """The points so far of each track on this frame, the last one its own."""
        rows = rows[rows["track_id"].notna()]
        if not len(rows):
            return {}
        out = {}
        rows = rows[rows["track_id"] >= 0].drop_duplicates("track_id")
        for track, x, y, w, h in rows[["track_id", "x", "y", "width", "height"]].astype("int64").itertuples(index=False):
            last, xs, ys = self.known.get(track, (frame, [], []))
            if self.busy is not None and self.busy - last > MAX_GAP:
                xs, ys = [], []
            xs, ys = [*xs, x + w // 2][-self.keep :], [*ys, y + h][-self.keep :]
            self.known[track] = (frame, xs, ys)
            out[track] = list(zip(xs, ys))
        # what no later frame can continue is forgotten
        self.known = {t: v for t, v in self.known.items() if frame - v[0] <= MAX_GAP}
        self.busy = frame
        return out


def _side(p: tuple[int, int], line: tuple) -> bool:
    a, b = sorted(line)
    if a[0] == b[0]:
        return p[0] < a[0]
    if a[1] == b[1]:
        return p[1] < a[1]
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0


def _inside(p: tuple[int, int], ring: list[tuple[int, int]]) -> bool:
    odd = False
    for k, (ax, ay) in enumerate(ring):
        bx, by = ring[k - 1]
        if (ay > p[1]) != (by > p[1]):
            odd ^= p[0] < math.trunc((bx - ax) * (p[1] - ay) / (by - ay)) + ax
    return odd


def cross_line_stream(rows: DataFrame, lines: dict[int, tuple], ttl_ms: int | None = None) -> DataFrame:
    """(channel_index, frame_index, ba_type, track_id), as cross_line; lines: two points by channel."""

    def step(state: Tracks, frame: int, part: pd.DataFrame) -> list[tuple]:
        line = lines.get(int(part["channel_index"].iloc[0]))
        seen = state.see(frame, part)
        return [] if line is None else [(B.CROSSLINE, t) for t, p in seen.items() if len(p) > 1 and _side(p[-1], line) != _side(p[-2], line)]

    return fold_channels(rows, Tracks, step, ["ba_type", "track_id"], "ba_type int, track_id long", ttl_ms)


class Stands(Tracks):
    """Tracks and how many frames on end each has stood."""

    own = "busy long, jammed boolean, changed long"
    maps = Tracks.maps | {"runs": ("track_id long", "frames long")}
    keep = B.CHECK_INTERVAL

    def load(self, own, maps):
        super().load(own, maps)
        self.runs = {t: n for t, (n,) in maps["runs"].items()}
        self.jammed, self.last = own[1:] if own else (False, 0)

    def dump(self):
        own, maps = super().dump()
        return (*own, self.jammed, self.last), maps | {"runs": {t: (n,) for t, n in self.runs.items()}}

    def stand(self, frame: int, rows: pd.DataFrame, ring: list[tuple[int, int]], far: float) -> dict[int, int]:
        """The runs that end on this frame, after counting it."""
        hits = {t for t, p in self.see(frame, rows).items() if len(p) >= B.CHECK_INTERVAL and _inside(p[-1], ring) and math.dist(p[-1], p[-B.CHECK_INTERVAL]) <= far}
        ended = {t: n for t, n in self.runs.items() if t not in hits}
        self.runs = {t: self.runs.get(t, 0) + 1 for t in hits}
        return ended


def stop_stream(rows: DataFrame, regions: dict[int, list[tuple[int, int]]], ttl_ms: int | None = None) -> DataFrame:
    """(channel_index, frame_index, ba_type, track_id), as stop_events; regions: rings by channel."""

    def step(state: Stands, frame: int, part: pd.DataFrame) -> list[tuple]:
        ring = regions.get(int(part["channel_index"].iloc[0]))
        if ring is None:
            return []
        ended = state.stand(frame, part, ring, B.STOP_DISTANCE)
        return [(B.STOP, t) for t, n in state.runs.items() if n == B.MIN_HITS] + [(B.UNSTOP, t) for t, n in ended.items() if n >= B.MIN_HITS]

    return fold_channels(rows, Stands, step, ["ba_type", "track_id"], "ba_type int, track_id long", ttl_ms)


def jam_stream(rows: DataFrame, regions: dict[int, list[tuple[int, int]]], ttl_ms: int | None = None) -> DataFrame:
    """(channel_index, frame_index, ba_type), as jam_events."""

    def step(state: Stands, frame: int, part: pd.DataFrame) -> list[tuple]:
        ring = regions.get(int(part["channel_index"].iloc[0]))
        if ring is None:
            return []
        state.stand(frame, part, ring, B.JAM_DISTANCE)
        full = sum(n >= B.MIN_HITS for n in state.runs.values()) >= B.MIN_STOPS
        if full and not state.jammed and frame - state.last > B.NOTIFY_SECONDS * int(np.max(part["fps"])):
            state.jammed, state.last = True, frame
            return [(B.JAM,)]
        if not full and state.jammed:
            state.jammed, state.last = False, frame
            return [(B.UNJAM,)]
        return []

    return fold_channels(rows, Stands, step, ["ba_type"], "ba_type int", ttl_ms)


class Synchroniser(StatefulProcessor):
    """Frames of two branches that wait for one another, an entry each; a timer a frame where frames have an event time."""

    def __init__(self, kind: str, timeout_ms: float, timed: bool, with_late: bool, controls: bool):
        self.kind, self.timeout_ms, self.timed = kind, timeout_ms, timed
        self.hidden = [c for c, shown in (("control_uid", controls), ("late", with_late)) if not shown]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.channel = handle.getValueState("channel", "last long, arrivals long, control_uid string")
        self.waiting = handle.getMapState("waiting", "arrival long", f"frame_index long, branch int, targets {self.kind}, due long, control_uid string")

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["channel_index", "frame_index", "targets", "alone", "control_uid", "late"])
        return (rows[~rows["late"].astype(bool)] if "late" in self.hidden else rows).drop(columns=self.hidden)

    @staticmethod
    def _controls_ahead(channel: int, waiting: dict[int, tuple]) -> list[tuple]:
        """Controls that no frame waits before go on, and wait no more."""
        out = []
        for n in list(waiting):
            frame, _, _, _, uid = waiting[n]
            if uid is None:
                break
            out.append((channel, frame, [], False, uid, False))
            del waiting[n]
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, arrivals, last_uid = self.channel.get() or (-1, 0, None)
        kept = {k[0]: v for k, v in self.waiting.iterator()} if arrivals else {}
        waiting, out = dict(sorted(kept.items())), []
        # a control comes before its frame
        rows = pd.concat(list(rows)).assign(order=lambda r: r["control_uid"].isna()).sort_values(["frame_index", "order", "branch"])
        due = (rows["due"] if self.timed else pd.Series(-1, index=rows.index)).tolist()
        for (frame, fps, targets, branch, uid), at in zip(rows[["frame_index", "fps", "targets", "branch", "control_uid"]].itertuples(index=False), due):
            if isinstance(uid, str):
                if uid != last_uid:
                    waiting[arrivals] = (int(frame), int(branch), [], -1, uid)
                    arrivals, last_uid = arrivals + 1, uid
                continue
            if frame <= last:
                out.append((key[0], frame, targets, True, None, True))
                continue
            met = None
            out += self._controls_ahead(key[0], waiting)
            for n, (f, side, own, _, control) in list(waiting.items()):
                if control is not None:
                    continue
                if (frame - f) * 1000 / fps >= self.timeout_ms:
                    out.append((key[0], f, own, True, None, False))
                    last = f
                elif f == frame and side != branch:
                    out.append((key[0], f, [*own, *targets] if side < branch else [*targets, *own], False, None, False))
                    last = met = f
                else:
                    continue
                del waiting[n]
                if met is not None:
                    break
                out += self._controls_ahead(key[0], waiting)
            if met is None:
                waiting[arrivals] = (int(frame), int(branch), list(targets), int(at), None)
                arrivals += 1
                if self.timed:
                    self.handle.registerTimer(int(at))
        for n in kept.keys() - waiting.keys():
            self.waiting.removeKey((n,))
        for n in waiting.keys() - kept.keys():
            self.waiting.updateValue((n,), waiting[n])
        self.channel.update((last, arrivals, last_uid))
        yield self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Frames that are due go on alone, though no newer frame has come."""
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        last, arrivals, last_uid = self.channel.get() or (-1, 0, None)
        kept = {k[0]: v for k, v in self.waiting.iterator()}
        waiting = dict(sorted(kept.items()))
        out += self._controls_ahead(key[0], waiting)
        for n, (frame, _, targets, due, uid) in sorted(waiting.items(), key=lambda e: e[1][0]):
            if uid is None and due <= now:
                out.append((key[0], frame, targets, True, None, False))
                last = max(last, frame)
                del waiting[n]
                out += self._controls_ahead(key[0], waiting)
        for n in kept.keys() - waiting.keys():
            self.waiting.removeKey((n,))
        if out:
            self.channel.update((last, arrivals, last_uid))
        yield self._rows(out)

    def close(self) -> None:
        pass


def sync_frames_stream(a: DataFrame, b: DataFrame, timeout_ms: float = 40, release: str | None = None, with_late: bool = False) -> DataFrame:
    """(channel_index, frame_index, targets, alone[, control_uid][, late]): frames (channel_index, frame_index, fps, targets ARRAY) of two branches joined, a's targets first.

    A frame that one branch has not brought goes on alone once a newer frame of its
    channel is timeout_ms away by frame numbers and fps; frames at or before the last
    one that went on are late and left out, or marked as late. release (an interval):
    frames have a frame_ts too, whose watermark is that far behind; a frame also goes on
    alone once the watermark is timeout_ms past it, so none waits for a branch or a
    channel that has fallen silent. Rows with a control_uid, where the branches have that
    column, are controls that come before their frame: one whose uid is not that of the
    control before goes on once no earlier frame waits. State: what waits, a timeout's
    worth.
    """
    use_rocksdb(a.sparkSession)
    kind, timed = a.schema["targets"].dataType.simpleString(), release is not None
    controls = "control_uid" in a.columns
    a, b = ((df if controls else df.withColumn("control_uid", F.lit(None).cast("string"))) for df in (a, b))
    more = ["control_uid", *(["frame_ts"] if timed else [])]
    both = a.select("channel_index", "frame_index", "fps", "targets", *more, F.lit(0).alias("branch")).unionByName(b.select("channel_index", "frame_index", "fps", "targets", *more, F.lit(1).alias("branch")))
    if timed:
        both = both.withWatermark("frame_ts", release).withColumn("due", F.unix_millis("frame_ts") + math.ceil(timeout_ms))
    schema = f"channel_index int, frame_index int, targets {kind}, alone boolean" + (", control_uid string" if controls else "") + (", late boolean" if with_late else "")
    return both.groupBy("channel_index").transformWithStateInPandas(Synchroniser(kind, timeout_ms, timed, with_late, controls), schema, "append", "eventTime" if timed else "none")


class Faces(ChannelState):
    """The channel's first face, and its identities in order, an entry each."""

    own = "base array<double>, next long"
    maps = {"identities": ("number long", "v array<double>")}
    most = 1000

    def load(self, own, maps):
        self.base, self.next = (np.array(own[0]), own[1]) if own and own[0] is not None else (None, 0)
        self.kept = dict(sorted(maps["identities"].items()))
        self.known = [np.array(v) for v, in self.kept.values()]

    def dump(self):
        return (None if self.base is None else self.base.tolist(), self.next), {"identities": self.kept}

    def add(self, v: np.ndarray) -> None:
        self.kept[self.next] = (v.tolist(),)
        self.known.append(v)
        self.next += 1
        if len(self.known) > self.most:
            del self.known[0], self.kept[next(iter(self.kept))]


def first_seen_stream(faces: DataFrame, max_identities: int = 1000, ttl_ms: int | None = None) -> DataFrame:
    """(channel_index, frame_index, vec_id, cosine, l2) of faces (channel_index, frame_index, vec_id, embedding), as first_seen_identities."""

    def start() -> Faces:
        state = Faces()
        state.most = max_identities
        return state

    def step(state: Faces, frame: int, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for vec, e in rows.sort_values("vec_id")[["vec_id", "embedding"]].itertuples(index=False):
            v = np.asarray(e, float)
            v = v / max(np.linalg.norm(v), 1e-12)
            if state.base is None:
                state.base = v
                continue
            like = np.array([state.base, *state.known]) @ v
            far = np.sqrt(np.maximum(0.0, 2 - 2 * like))
            if like.max() < SAME_COSINE and far.min() > SAME_L2:
                state.add(v)
                out.append((vec, round(float(like[0]), 6), round(float(far[0]), 6)))
        return out

    return fold_channels(faces, start, step, ["vec_id", "cosine", "l2"], "vec_id long, cosine double, l2 double", ttl_ms)


class _SentPlates(StatefulProcessor):
    """The tracks and texts of one channel that have been sent, an entry each; only those of the micro-batch's plates are looked up."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track_id long", "frame_index int", self.ttl_ms)
        self.texts = handle.getMapState("texts", "text string", "frame_index int", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent = []
        # a track's further rows with one text can only be held back as its first is
        plates = pd.concat(list(rows)).sort_values(["frame_index", "track_id", "text"]).drop_duplicates(["track_id", "text"])
        for row in plates[["channel_index", "frame_index", "track_id", "color", "text"]].itertuples(index=False):
            if not self.tracks.containsKey((row.track_id,)) and not self.texts.containsKey((row.text,)):
                self.tracks.updateValue((row.track_id,), (row.frame_index,))
                self.texts.updateValue((row.text,), (row.frame_index,))
                sent.append(tuple(row))
        yield pd.DataFrame(sent, columns=["channel_index", "frame_index", "track_id", "color", "text"])

    def close(self) -> None:
        pass


def first_per_plate_stream(plates: DataFrame, min_width: int = 100, min_height: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """(channel_index, frame_index, track_id, color, text), as first_per_plate; frames come in order from micro-batch to micro-batch. ttl_ms: how long what was sent is remembered."""
    use_rocksdb(plates.sparkSession)
    plate = parse_plate(F.col("label"))
    good = plates.where((F.col("track_id") >= 0) & (F.col("width") >= min_width) & (F.col("height") >= min_height) & plate.isNotNull())
    rows = good.select("channel_index", "frame_index", F.col("track_id").cast("long").alias("track_id"), plate["color"].alias("color"), plate["text"].alias("text"))
    return rows.groupBy("channel_index").transformWithStateInPandas(_SentPlates(ttl_ms), "channel_index int, frame_index int, track_id long, color string, text string", "append", "processingTime" if ttl_ms else "none")
