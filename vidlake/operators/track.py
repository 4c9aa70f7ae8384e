"""Track history, trails, and box tracking."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.functions.geometry import distance, track_point
from vidlake.operators.joins import join_small
from vidlake.operators.ordered import busy_frames
from vidlake.operators.storage import written

log = logging.getLogger(__name__)

#: A track that no target of a later non-empty frame has seen for more than this many frames starts anew.
MAX_GAP = 25


def box() -> Column:
    return F.struct("x", "y", "width", "height")


def one_per_track(targets: DataFrame) -> DataFrame:
    """One row for each channel, frame and track: the lowest target_no, where there is one."""
    if "target_no" not in targets.columns:
        return targets.dropDuplicates(["channel_index", "frame_index", "track_id"])
    first = Window.partitionBy("track_id", "channel_index", "frame_index").orderBy("target_no")
    return targets.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def track_history(targets: DataFrame, tasks: int | None = None, busy: DataFrame | None = None) -> DataFrame:
    """targets with seg (how often the track started anew), history (its length so far) and prev, the point before.

    A track starts anew when, at its next target, more than MAX_GAP frames lie between its
    last frame and the channel's last frame with targets before that one. Only rows
    whose own gap is that wide can do so; their frames are found on three columns and
    joined as a list for each track, so the wide rows are shuffled once, by track. Rows
    without a track (track_id below 0 or null) have no history.

    tasks: into how many tasks targets are dealt by channel and track, where they are:
    the lists are dealt alike, and the wide rows are not shuffled again into the session's
    number of partitions. busy: the frames that targets are on, where they are known.
    Windows sort by the track first, as the channels are too few to tell rows apart.
    """
    tracked = targets.where("track_id >= 0").withColumn("point", track_point(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    by_channel = Window.partitionBy("channel_index").orderBy("frame_index")
    track = Window.partitionBy("track_id", "channel_index").orderBy("frame_index")
    seen = targets.where("track_id >= 0").select("channel_index", "track_id", "frame_index")
    apart = seen.withColumn("before", F.lag("frame_index").over(track)).where(F.col("frame_index") - F.col("before") > MAX_GAP + 1)
    busy = busy_frames(targets) if busy is None else busy.select("channel_index", "frame_index")
    busy = busy.withColumn("busy_before", F.lag("frame_index").over(by_channel))
    anew = apart.join(busy.hint("merge"), ["channel_index", "frame_index"]).where(F.col("busy_before") - F.col("before") > MAX_GAP)
    keys = ["channel_index", "track_id"]
    dealt = anew.select(*keys, "frame_index").repartition(tasks, *keys) if tasks else anew
    starts = dealt.groupBy(*keys).agg(F.collect_list("frame_index").alias("_starts"))
    joined = tracked.join(starts.hint("shuffle_hash"), keys, "left")
    passed = F.size(F.filter("_starts", lambda f: f <= F.col("frame_index")))
    seg = joined.withColumn("seg", F.when(F.col("_starts").isNull(), 0).otherwise(passed).cast("long"))
    # partitioned by the same keys, so neither window adds a shuffle
    own = Window.partitionBy("track_id", "channel_index", "seg").orderBy("frame_index")
    return seg.withColumn("history", F.row_number().over(own)).withColumn("prev", F.lag("point").over(own)).drop("_starts")


def with_point_before(history: DataFrame, rows: int, name: str) -> DataFrame:
    """history and the point that many rows earlier in the same segment."""
    own = Window.partitionBy("track_id", "channel_index", "seg").orderBy("frame_index")
    return history.withColumn(name, F.lag("point", rows).over(own))


def trail_lengths(history: DataFrame) -> DataFrame:
    """Per segment: points, first and last frame, and the length of the polyline through its points."""
    steps = history.withColumn("step", F.coalesce(distance(F.col("point"), F.col("prev")), F.lit(0.0)))
    return steps.groupBy("channel_index", "track_id", "seg").agg(
        F.count(F.lit(1)).alias("points"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.round(F.sum("step"), 4).alias("length")
    )


def track_trail(history: DataFrame, last: int) -> DataFrame:
    """history and its last points, oldest first, as drawn behind a target."""
    own = Window.partitionBy("track_id", "channel_index", "seg").orderBy("frame_index")
    return history.withColumn("trail", F.collect_list("point").over(own.rowsBetween(-(last - 1), 0)))


# ---- tracking by predicted boxes ----

MAX_AGE, MIN_HITS, MATCH_IOU, REPORT_IOU = 1, 3, 0.5, 0.8


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every box of b; boxes are x, y, width, height."""
    ax, ay, aw, ah = a.T[:, :, None]
    bx, by, bw, bh = b.T
    inter, side = np.minimum(ax + aw, bx + bw), np.minimum(ay + ah, by + bh)
    inter -= np.maximum(ax, bx)
    side -= np.maximum(ay, by)
    np.maximum(inter, 0, out=inter)
    inter *= np.maximum(side, 0, out=side)
    union = aw * ah + bw * bh
    union -= inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 1e-12)


#: Up to how many rows or columns plain lists are quicker than arrays.
FEW = 16


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, by shortest augmenting paths with potentials.

    Rows whose least column is still free take it first; paths are searched for the others.
    """
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    owner = _few(c.tolist()) if c.shape[1] <= FEW else _many(c)
    pairs = [(int(i), j) for j, i in enumerate(owner[:-1]) if i >= 0]
    return [(j, i) for i, j in pairs] if flip else pairs


def _few(c: list[list[float]]) -> list[int]:
    """The row that owns each column, and a place more; no more rows than columns."""
    m = len(c[0])
    u, v, owner, waiting = [min(row) for row in c], [0.0] * m, [-1] * (m + 1), []
    for i, row in enumerate(c):
        j = row.index(u[i])
        if owner[j] < 0:
            owner[j] = i
        else:
            waiting.append(i)
    for row in waiting:
        owner[m], at = row, m
        least, before, open_, done = [float("inf")] * m, [m] * m, list(range(m)), []
        while owner[at] >= 0:
            i = owner[at]
            ci, ui = c[i], u[i]
            step, to = float("inf"), -1
            for j in open_:
                gap = ci[j] - ui - v[j]
                if gap < least[j]:
                    least[j], before[j] = gap, at
                if least[j] < step:
                    step, to = least[j], j
            u[row] += step
            for j in done:
                u[owner[j]] += step
                v[j] -= step
            open_.remove(to)
            for j in open_:
                least[j] -= step
            done.append(to)
            at = to
        while at != m:
            owner[at] = owner[before[at]]
            at = before[at]
    return owner


def _many(c: np.ndarray) -> np.ndarray:
    """As _few, with arrays."""
    n, m = c.shape
    u, v, owner, waiting = np.append(c.min(1), 0.0), np.zeros(m + 1), np.full(m + 1, -1), []
    for i, j in enumerate(c.argmin(1).tolist()):
        if owner[j] < 0:
            owner[j] = i
        else:
            waiting.append(i)
    for row in waiting:
        owner[m], at = row, m
        least, before, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            i = owner[at]
            gap = c[i] - u[i] - v[:m]
            better = ~done[:m] & (gap < least[:m])
            least[:m][better], before[:m][better] = gap[better], at
            open_ = np.where(done[:m], np.inf, least[:m])
            to = int(open_.argmin())
            step = open_[to]
            u[owner[done]] += step
            v[done] -= step
            least[:m][~done[:m]] -= step
            at = to
        while at != m:
            owner[at] = owner[before[at]]
            at = before[at]
    return owner


def _small(w: list[list[float]]) -> list[tuple[int, int]]:
    """Rows and columns of greatest total weight; few of either are compared outright."""
    n, m = len(w), len(w[0])
    if n == 1 or m == 1:
        k = max(range(n * m), key=lambda k: w[k // m][k % m])
        return [divmod(k, m)]
    if n == 2 and m == 2:
        (a, b), (c, d) = w
        return [(0, 0), (1, 1)] if a + d >= b + c else [(0, 1), (1, 0)]
    return assign(1 - np.array(w))


def _certain(like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of pairs that overlap at least as much as the best others of their row and of their column together: what a matching without such a pair gains elsewhere is no more than the pair."""
    to, most = like.argmax(1), like.argmax(0)
    best = like[np.arange(len(like)), to]
    i = np.flatnonzero((best > 0) & (most[to] == np.arange(len(like))))
    j = to[i]
    rest = like.copy()
    rest[i, j] = 0
    sure = best[i] >= rest.max(1)[i] + rest.max(0)[j]
    return i[sure], j[sure]


def match(like: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns matched for the greatest total overlap.

    Certain pairs are taken first. Pairs without overlap add nothing, so each group of
    the other rows and columns that overlap one another, directly or through others, is
    solved by itself.
    """
    i, j = _certain(like)
    pairs = list(zip(i.tolist(), j.tolist()))
    if len(pairs) == min(like.shape):
        return pairs
    rows, cols = (np.delete(np.arange(n), gone) for n, gone in zip(like.shape, (i, j)))
    rows, cols, rest = rows.tolist(), cols.tolist(), like[rows[:, None], cols].tolist()
    some = [{k for k, v in enumerate(own) if v > 0} for own in rest]
    waiting = [k for k, own in enumerate(some) if own]
    while waiting:
        r, c = [waiting[0]], set(some[waiting[0]])
        waiting = waiting[1:]
        while more := [k for k in waiting if not some[k].isdisjoint(c)]:
            waiting = [k for k in waiting if some[k].isdisjoint(c)]
            r += more
            c.update(*(some[k] for k in more))
        r, c = sorted(r), sorted(c)
        pairs += [(rows[r[a]], cols[c[b]]) for a, b in _small([[rest[k][n] for n in c] for k in r])]
    return pairs


#: Noise of the process and of the measurement (fixed values).
_Q, _R = 1e-2, 1e-1


def _measures(boxes: np.ndarray) -> np.ndarray:
    """Centre, area and aspect of boxes, a row each."""
    x, y, w, h = boxes.T.astype(float)
    return np.array([x + w / 2, y + h / 2, w * h, w / np.maximum(h, 1e-9)])


def _boxes(x: np.ndarray) -> np.ndarray:
    """Boxes of states, which are columns; one that reaches over the left or upper edge with its centre inside starts at the edge, one without area is nan."""
    out = np.empty((4, x.shape[1]))
    with np.errstate(invalid="ignore", divide="ignore"):
        np.sqrt(x[2] * x[3], out=out[2])
        np.divide(x[2], out[2], out=out[3])
    lo = x[:2] - out[2:] / 2
    lo[(lo < 0) & (x[:2] > 0)] = 0.0
    out[:2] = lo
    return out.T


class Trackers:
    """Constant-velocity trackers of one channel, as arrays: centre, area and aspect of a box, and the speed of the first three.

    Covariances start as one and noises are diagonal and alike, so of a tracker's
    7 x 7 numbers only five differ: those of a measured part with itself, with its speed,
    of its speed with it and with itself (the same for centre and area), and the
    aspect's. State and these lie in rows, a column a tracker; x and p give them a
    tracker at a time and whole. A streak counts up to MIN_HITS.
    """

    def __init__(self):
        self.state, self.cov = np.zeros((7, 0)), np.zeros((5, 0))
        self.ids, self.age, self.streak = (np.zeros(0, np.int64) for _ in range(3))
        self.next_id = 1

    @property
    def x(self) -> np.ndarray:
        return self.state.T

    @x.setter
    def x(self, x: np.ndarray) -> None:
        self.state = np.array(x.T)

    @property
    def p(self) -> np.ndarray:
        out, k = np.zeros((self.cov.shape[1], 7, 7)), np.arange(3)
        for (i, j), v in zip(((k, k), (k, k + 4), (k + 4, k), (k + 4, k + 4), ([3], [3])), self.cov):
            out[:, i, j] = v[:, None]
        return out

    @p.setter
    def p(self, p: np.ndarray) -> None:
        self.cov = np.array([p[:, 0, 0], p[:, 0, 4], p[:, 4, 0], p[:, 4, 4], p[:, 3, 3]])

    def _keep(self, which: np.ndarray) -> None:
        if not which.all():
            self.state, self.cov = self.state[:, which], self.cov[:, which]
            self.ids, self.age, self.streak = self.ids[which], self.age[which], self.streak[which]

    def _start(self, boxes: np.ndarray) -> None:
        n = len(boxes)
        if n:
            fresh = np.zeros((7, n))
            fresh[:4] = _measures(boxes)
            self.state = np.concatenate([self.state, fresh], axis=1)
            self.cov = np.concatenate([self.cov, np.tile([[1.0], [0.0], [0.0], [1.0], [1.0]], n)], axis=1)
            self.ids = np.concatenate([self.ids, np.arange(self.next_id, self.next_id + n)])
            self.age, self.streak = (np.concatenate([v, np.zeros(n, np.int64)]) for v in (self.age, self.streak))
            self.next_id += n

    def _predict(self) -> None:
        self.state[:3] += self.state[4:]
        own, ahead, behind, speed, aspect = self.cov
        self.cov = np.array([(own + behind) + (ahead + speed) + _Q, ahead + speed, behind + speed, speed + _Q, aspect + _Q])

    def _correct(self, i: np.ndarray, boxes: np.ndarray) -> None:
        state, cov = self.state[:, i], self.cov[:, i]
        off = _measures(boxes) - state[:4]
        own, ahead, behind, speed, aspect = cov
        of_own = 1 / (own + _R)
        near, fast, slim = own * of_own, behind * of_own, aspect * (1 / (aspect + _R))
        state[:3] += near * off[:3]
        state[3] += slim * off[3]
        state[4:] += fast * off[:3]
        self.state[:, i] = state
        self.cov[:, i] = cov - np.array([near * own, near * ahead, fast * own, fast * ahead, slim * aspect])

    def step(self, boxes: np.ndarray) -> np.ndarray:
        """Ids of the boxes of the next frame, -1 where none is sure yet."""
        ids = np.full(len(boxes), -1, np.int64)
        if not len(self.ids):
            self._start(boxes)
            return ids
        self._predict()
        self.streak[self.age > 0] = 0
        self.age += 1
        place, found = _boxes(self.state), boxes.astype(float)
        seen = (place[:, 0] >= 0) & (place[:, 1] >= 0)
        self._keep(seen)
        taken = np.zeros(len(boxes), bool)
        if len(boxes) and len(self.ids):
            like = overlap(place[seen], found)
            i, j = np.array(match(like), np.int64).reshape(-1, 2).T
            near = like[i, j] >= MATCH_IOU
            i, j = i[near], j[near]
            if len(i):
                self._correct(i, found[j])
                self.age[i], taken[j] = 0, True
                self.streak[i] = np.minimum(self.streak[i] + 1, MIN_HITS)
            sure = np.flatnonzero((self.age < 1) & (self.streak >= MIN_HITS))
            if len(sure):
                close = overlap(_boxes(self.state[:, sure]), found) > REPORT_IOU
                # where several do, the later tracker's id stays
                last = len(sure) - 1 - close[::-1].argmax(0)
                ids = np.where(close.any(0), self.ids[sure][last], ids)
        self._keep(self.age <= MAX_AGE)
        self._start(boxes[~taken])
        return ids


def sort_track(targets: DataFrame, partitions: int) -> DataFrame:
    """targets (channel_index, frame_index, target_no, x, y, width, height) with the track_id of each, for channels of few frames.

    Each channel is followed frame by frame, its rows streaming through one task in
    order; the state is the live trackers, so a channel never has to fit in memory.
    Ids count up from 1 in each channel; -1 where a track is not sure yet. A tracker is
    dropped after more than MAX_AGE frames without a match. Frames without targets are
    not seen. partitions: an explicit number, which adaptive execution leaves as it is.
    """
    names = targets.columns
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.drop("track_id").schema) + ", track_id long"

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, trackers, held = None, Trackers(), None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            # the last frame may go on in the next batch
            last = (rows["channel_index"] == rows["channel_index"].iloc[-1]) & (rows["frame_index"] == rows["frame_index"].iloc[-1])
            held, ready = rows[last], rows[~last].dropna(subset=["channel_index", "frame_index"])
            if not len(ready):
                continue
            # a batch's frames leave together: a table a frame costs as much as following it
            c, f, place = ready["channel_index"].to_numpy(), ready["frame_index"].to_numpy(), ready[["x", "y", "width", "height"]].to_numpy()
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (f[1:] != f[:-1])) + 1
            ids = []
            for at, frame in zip((0, *cuts), np.split(place, cuts)):
                if c[at] != channel:
                    channel, trackers = c[at], Trackers()
                ids.append(trackers.step(frame))
            yield ready.drop(columns="track_id", errors="ignore").assign(track_id=np.concatenate(ids))
        if held is not None and len(held):
            if held["channel_index"].iloc[0] != channel:
                trackers = Trackers()
            yield held.drop(columns="track_id", errors="ignore").assign(track_id=trackers.step(held[["x", "y", "width", "height"]].to_numpy()))

    order = [c for c in ("channel_index", "frame_index", "target_no") if c in names]
    return targets.repartition(partitions, "channel_index").sortWithinPartitions(*order).mapInPandas(follow, out)


#: Frames of a stretch, at least, those of the stretch before that are followed first, and how many frame numbers are dealt together.
STRETCH_FRAMES, WARM_FRAMES, BLOCK = 4000, 600, 200
#: How often stretches that began wrongly are followed anew side by side; then the rest of their channel goes on in order.
AGAIN = 3
_TOLD = "_begin string, _end string, _state binary, _starts long, _refs array<long>"


def _blocks(targets: DataFrame) -> DataFrame:
    """(channel_index, _block, _run, _warm): the stretch of each block of frame numbers, and whether the next stretch follows it first."""
    frames = busy_frames(targets.where("channel_index is not null"))
    blocks = frames.groupBy("channel_index", F.floor(F.col("frame_index") / BLOCK).alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("channel_index").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.withColumn("_run", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / STRETCH_FRAMES))
    after = Window.partitionBy("channel_index", "_run").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    more = Window.partitionBy("channel_index").orderBy("_run").rangeBetween(1, Window.unboundedFollowing)
    return runs.withColumn("_warm", F.coalesce(F.sum("_n").over(after), F.lit(0)) < WARM_FRAMES).select("channel_index", "_block", "_run", "_warm", F.min("_run").over(more).alias("_next"))


def _packed(t: Trackers) -> bytes:
    return np.concatenate([t.state, t.cov, [t.age, t.streak]]).tobytes()


def _unpacked(data: bytes) -> Trackers:
    t, rows = Trackers(), np.frombuffer(data).reshape(14, -1)
    t.state, t.cov = rows[:7].copy(), rows[7:12].copy()
    t.age, t.streak = rows[12:].astype(np.int64)
    t.ids = np.zeros(len(t.age), np.int64)
    return t


def _digest(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=16).hexdigest()


def _follow(names: list[str]):
    """A task's function: its chains of stretches frame by frame, the targets of own frames with the number of their tracker, and a row a stretch that tells how it began and ended.

    A tracker that starts in the stretch has its number there, from 0 on; one that the
    stretch began with is -2 less its place among those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trackers, stretch, begin, held, schema = None, Trackers(), None, None, None, None

        def told() -> pa.RecordBatch:
            end = _packed(trackers)
            values = {"channel_index": key[0], "_run": stretch, "_begin": begin, "_end": _digest(end), "_state": end, "_starts": trackers.next_id, "_refs": trackers.ids.tolist()}
            return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

        def frames(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal key, trackers, stretch, begin, schema
            if schema is None:
                kinds = {"track_id": pa.int64(), "_run": pa.int64(), "_begin": pa.string(), "_end": pa.string(), "_state": pa.binary(), "_starts": pa.int64(), "_refs": pa.list_(pa.int64())}
                schema = pa.schema([t.schema.field(n) for n in names] + [pa.field(n, k) for n, k in kinds.items()])
            c, chain, runs, own = (t.column(n).to_numpy() for n in ("channel_index", "_chain", "_run", "_own"))
            f = t.column("frame_index").fill_null(0).to_numpy()
            seed = t.column("_state").is_valid().to_numpy()
            place = np.stack([t.column(n).to_numpy() for n in ("x", "y", "width", "height")], axis=1)
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (chain[1:] != chain[:-1]) | (f[1:] != f[:-1]) | seed[:-1]) + 1
            ids = np.full(len(c), -1, np.int64)
            for lo, hi in zip((0, *cuts), (*cuts, len(c))):
                if key != (c[lo], chain[lo]):
                    if stretch is not None:
                        yield told()
                    key, trackers, stretch = (c[lo], chain[lo]), Trackers(), None
                if seed[lo]:
                    trackers = _unpacked(t.column("_state")[int(lo)].as_py())
                    continue
                if own[lo] and runs[lo] != stretch:
                    if stretch is not None:
                        yield told()
                    stretch, begin = int(runs[lo]), _digest(_packed(trackers))
                    trackers.ids, trackers.next_id = -2 - np.arange(len(trackers.ids)), 0
                ids[lo:hi] = trackers.step(place[lo:hi])
            mine = own & ~seed
            if mine.any():
                rows = t.select(names).append_column("track_id", pa.array(ids)).append_column("_run", pa.array(runs)).filter(pa.array(mine))
                yield from pa.table([*rows.columns, *(pa.nulls(len(rows), k.type) for k in schema if k.name not in rows.column_names)], schema=schema).to_batches()

        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            # the last frame may go on in the next batch
            n = len(t) - 1
            c, chain, f = (t.column(k) for k in ("channel_index", "_chain", "frame_index"))
            last = np.ones(len(t), bool)
            for k in (c, chain, f):
                own = k.fill_null(-1).to_numpy()
                last &= own == own[n]
            cut = len(t) - int(last[::-1].argmin()) if not last.all() else 0
            held = t.slice(cut)
            if cut:
                yield from frames(t.slice(0, cut))
        if held is not None:
            yield from frames(held)
            if stretch is not None:
                yield told()

    return run


def _numbered(runs: pd.DataFrame) -> pd.DataFrame:
    """A channel's stretches with the trackers that started before them, and the ids of those that they began with."""
    carried, count, out = np.zeros(0, np.int64), 0, []
    for r in runs.sort_values("_run").itertuples(index=False):
        out.append((r[0], r[1], r[2], count, carried.tolist()))
        refs = np.array(r[4], np.int64)
        ids = refs + count + 1
        ids[refs < 0] = carried[-2 - refs[refs < 0]]
        carried, count = ids, count + int(r[3])
    return pd.DataFrame(out, columns=["channel_index", "_run", "_round", "_before", "_carried"])


def sort_track_stretches(targets: DataFrame, partitions: int) -> DataFrame:
    """As sort_track, and the same ids, with a channel's stretches of STRETCH_FRAMES frames followed side by side.

    A stretch begins with what WARM_FRAMES frames before it leave of no trackers: by then
    those that a channel really has are, as a rule, the same to the last bit, as boxes
    draw them there and older ones are gone. That is checked, not believed: where a
    stretch did not begin with exactly the trackers that the one before ended with, it is
    followed again from those, until all agree; after AGAIN rounds the rest of such a
    channel goes on in order, in one task. Then ids are counted on from stretch to
    stretch, a row each. Every tracked row is written once, and again where it was
    followed again. partitions: into how many tasks stretches are dealt.
    """
    names = [c for c in targets.columns if c != "track_id"]
    keys, order = ["channel_index", "_run"], [c for c in ("channel_index", "_chain", "frame_index", "target_no") if c == "_chain" or c in names]
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema}
    out = ", ".join(f"`{n}` {kinds[n]}" for n in names) + f", track_id long, _run long, {_TOLD}"

    def followed(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(partitions, "channel_index", "_chain").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        return written(dealt.mapInArrow(_follow(names), out), "tracked")

    blocks = _blocks(targets)
    placed = join_small(targets.select(*names).withColumn("_block", F.floor(F.col("frame_index") / BLOCK)), blocks, ["channel_index", "_block"])
    own = F.struct(F.col("_run").alias("_chain"), F.lit(True).alias("_own"))
    ahead = F.struct(F.col("_next").alias("_chain"), F.lit(False).alias("_own"))
    spread = placed.select(*names, "_run", F.explode(F.when(F.col("_warm") & F.col("_next").isNotNull(), F.array(own, ahead)).otherwise(F.array(own))).alias("_to"))
    tables = [followed(spread.select(*names, "_run", "_to._chain", "_to._own", F.lit(None).cast("binary").alias("_state")))]
    told = lambda n: tables[n].where("_begin is not null").select(*keys, F.lit(n).alias("_round"), "_begin", "_end", "_state", "_starts", "_refs")
    runs = written(told(0), "stretches")
    while True:
        in_order = Window.partitionBy("channel_index").orderBy("_run")
        wrong = runs.withColumns({"_ended": F.lag("_end").over(in_order), "_seed": F.lag("_state").over(in_order)}).where(F.col("_begin") != F.col("_ended"))
        wrong = written(wrong.select(*keys, "_seed"), "wrong")
        count, n = wrong.count(), len(tables)
        if not count:
            break
        log.info("tracking: %d stretches are followed again", count)
        if n <= AGAIN:
            again = wrong.select(*keys, F.col("_run").alias("_chain"))
        else:
            firsts = wrong.groupBy("channel_index").agg(F.min("_run").alias("_chain"))
            again = runs.select(*keys).join(firsts.hint("merge"), "channel_index").where("_run >= _chain")
            wrong = wrong.join(firsts.withColumnRenamed("_chain", "_run").hint("merge"), keys)
        rows = join_small(tables[0].where("_begin is null").select(*names, "_run"), again, keys).select(*names, "_run", "_chain", F.lit(True).alias("_own"), F.lit(None).cast("binary").alias("_state"))
        seeds = wrong.select("channel_index", "_run", F.col("_run").alias("_chain"), F.lit(True).alias("_own"), F.col("_seed").alias("_state"))
        tables.append(followed(rows.unionByName(seeds, allowMissingColumns=True)))
        runs = written(told(n).unionByName(runs.join(again.select(*keys).hint("merge"), keys, "left_anti")), "stretches")
    small = runs.select(*keys, "_round", "_starts", "_refs").groupBy("channel_index").applyInPandas(_numbered, f"channel_index {kinds['channel_index']}, _run long, _round int, _before long, _carried array<long>")
    found = None
    for n, t in enumerate(tables):
        own = t.where("_begin is null").select(*names, "track_id", "_run", F.lit(n).alias("_round"))
        found = own if found is None else found.unionByName(own)
    both = join_small(found, small, [*keys, "_round"])
    number = F.when(F.col("track_id") == -1, F.col("track_id")).when(F.col("track_id") >= 0, F.col("_before") + F.col("track_id") + 1).otherwise(F.element_at("_carried", (-1 - F.col("track_id")).cast("int")))
    return both.select(*names, number.alias("track_id"))
