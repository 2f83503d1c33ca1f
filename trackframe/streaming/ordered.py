"""Stateful operators over frames in order, however late their boxes arrive.

Boxes of a key wait in state by blocks of frames.  When the watermark passes a frame, no box
of it can still come (later ones count as late and are dropped), so the frame is
handed on; frames go one by one, in order.  Results therefore don't depend on how
boxes were dealt to micro-batches and equal the batch operators' on all frames that
the watermark has passed.  State is bounded by the boxes within the watermark's delay,
a task holds one block
of frames (``BLOCK_MS``) at a time besides what the operator keeps.

Needs the RocksDB state store; :func:`ordered` chooses it where the session names none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..config import FilterConfig, TrackerConfig
from ..functions import geometry as g
from ..operators import overlaps
from ..operators.detections import shrink

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a pandas frame that is handed on.
OUT_ROWS = 2000
#: Boxes wait in blocks of so much event time, so that a state entry is read and written for a block, not for a box.
BLOCK_MS = 500
Frame = dict[str, list]


class InFrameOrder(StatefulProcessor):
    """Buffers rows; :meth:`step` gets each frame's columns, sorted by detection id, in order of frames."""

    def __init__(self, schema: StructType, out: list[str], keeps_ms: int):
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields if f.name != "event_ts" and not f.name.startswith("_")}
        self.out, self.keeps_ms = out, keeps_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"`{c}` array<{t}>" for c, t in self.types.items())
        self.waiting = handle.getMapState("waiting", "block bigint", "ms array<bigint>, " + arrays)
        self.last = handle.getValueState("last", "ms bigint")
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        """Declare further state."""

    def begin(self, key: tuple) -> None:
        """Load what frames need, before the first of some."""

    def step(self, key: tuple, frame: int, rows: Frame) -> Iterator[tuple]:
        """Output rows of one frame."""
        raise NotImplementedError

    def end(self, key: tuple) -> None:
        """Store what :meth:`begin` loaded."""

    def forget(self) -> None:
        """Clear further state, long after the last frame."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            due = -(-pdf["event_ts"].astype("datetime64[us]").astype("int64") // 1000)
            first = int(due.min()) if first is None else min(first, int(due.min()))
            for block, part in pdf.drop(columns="event_ts").assign(_ms=due).groupby(due // BLOCK_MS):
                new = [part["_ms"].tolist(), *(part[c].astype(object).where(part[c].notna(), None).tolist() for c in self.types)]
                have = self.waiting.getValue((int(block),)) or [[]] * len(new)
                self.waiting.updateValue((int(block),), tuple([*h, *n] for h, n in zip(have, new, strict=True)))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, key = timerValues.getCurrentWatermarkInMs(), tuple(key)
        blocks = sorted(k[0] for k in self.waiting.keys())
        due = [b for b in blocks if b * BLOCK_MS <= now]
        next_ms = min((b * BLOCK_MS for b in blocks[len(due) :]), default=None)
        last, out = self.last.get()[0] if self.last.exists() else None, []
        if due:
            self.begin(key)
        for block in due:
            rows = list(map(list, self.waiting.getValue((block,))))
            at = {c: k + 1 for k, c in enumerate(self.types)}
            order = sorted(range(len(rows[0])), key=lambda i: (rows[0][i], rows[at["frame_id"]][i], rows[at["det_id"]][i]))
            ready = [i for i in order if rows[0][i] <= now]
            for frame, some in groupby(ready, key=lambda i: rows[at["frame_id"]][i]):
                own = list(some)
                out.extend(self.step(key, frame, {c: [rows[k][i] for i in own] for c, k in at.items()}))
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=self.out)
                    out = []
            last = rows[0][ready[-1]] if ready else last
            if left := order[len(ready) :]:
                self.waiting.updateValue((block,), tuple([v[i] for i in left] for v in rows))
                next_ms = min(rows[0][left[0]], next_ms or rows[0][left[0]])
            else:
                self.waiting.removeKey((block,))
        if due:
            self.end(key)
        if out:
            yield pd.DataFrame(out, columns=self.out)
        if next_ms is not None:
            self.handle.registerTimer(max(next_ms, now + 1))
        elif last is not None and last + self.keeps_ms > now:
            self.handle.registerTimer(last + self.keeps_ms)
        elif last is not None:
            self.forget()
            last = None
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))


def ordered(df: DataFrame, keys: list[str], processor: type[InFrameOrder], out_schema: StructType, late: str, keeps: str, **more: Any) -> DataFrame:
    """``processor`` over ``df`` by ``keys``; state of a key ends ``keeps`` of event time after its last frame."""
    if "RocksDB" not in df.sparkSession.conf.get(PROVIDER, ""):
        df.sparkSession.conf.set(PROVIDER, ROCKSDB)
    made = processor(df.schema, out_schema.names, int(pd.Timedelta(keeps).total_seconds() * 1000), **more)
    return df.withWatermark("event_ts", late).groupBy(*keys).transformWithStateInPandas(made, out_schema, "append", "eventTime")


class _Numbered(InFrameOrder):
    def setup(self, handle):
        self.count = handle.getValueState("count", "n bigint")

    def begin(self, key):
        self.n = self.count.get()[0] if self.count.exists() else 0

    def step(self, key, frame, rows):
        for row in zip(*rows.values(), strict=True):
            self.n += 1
            yield (*row, self.n)

    def end(self, key):
        self.count.update((self.n,))


def in_frame_order(df: DataFrame, late: str = "5 seconds") -> DataFrame:
    """ST6: the boxes of each video in order of frame and id, numbered from 1 (``place``), each once its frame is complete.

    The number goes on as long as the stream lives.
    """
    rows = StructType([f for f in df.schema.fields if f.name != "event_ts"])
    return ordered(df, ["video_id"], _Numbered, StructType([*rows.fields, StructField("place", LongType())]), late, "36500 days")


class _Steady(InFrameOrder):
    def __init__(self, schema, out, keeps_ms, cfg):
        super().__init__(schema, out, keeps_ms)
        self.cfg = cfg

    def setup(self, handle):
        self.recent = handle.getValueState("recent", "areas array<double>")

    def begin(self, key):
        self.areas = list(self.recent.get()[0]) if self.recent.exists() else []

    def step(self, key, frame, rows):
        boxes = []
        for x, y, w, h in zip(rows["x"], rows["y"], rows["width"], rows["height"], strict=True):
            x, y, w, h, self.areas = shrink(x, y, w, h, self.areas, self.cfg)
            boxes.append((x, y, w, h))
        made = rows | dict(zip(("x", "y", "width", "height"), map(list, zip(*boxes, strict=True)), strict=True))
        return zip(*(made[c] for c in self.out), strict=True)

    def end(self, key):
        self.recent.update((self.areas,))

    def forget(self):
        self.recent.clear()


def steady_areas(df: DataFrame, cfg: FilterConfig = FilterConfig(), late: str = "5 seconds", expires: str = "1 hour") -> DataFrame:
    """ST4: the batch operator of the same aim with its state (the last areas) kept by video and grid cell.

    A cell without a box for ``expires`` of event time loses its state.
    """
    cells = df.withColumn("_gx", F.floor(g.center_x() / cfg.grid)).withColumn("_gy", F.floor(g.center_y() / cfg.grid))
    rows = StructType([f for f in df.schema.fields if f.name != "event_ts"])
    return ordered(cells, ["video_id", "_gx", "_gy"], _Steady, rows, late, expires, cfg=cfg)


Track = tuple[float, float, float, float, int]


def link_frame(frame: int, rows: Frame, live: dict[int, Track], cfg: TrackerConfig) -> list[tuple[int, int]]:
    """(det_id, track) of the boxes of one frame; ``live`` (track to its last box and frame) is brought up to date.

    Confident boxes choose first, then doubtful ones: in order of overlap, ties
    by box and track, each box and each track once.  A confident box that
    matches nothing starts a track named by its id.
    """
    for t in [t for t, b in live.items() if frame - b[4] > cfg.buffer_frames]:
        del live[t]
    box = np.array([rows[c] for c in ("x", "y", "width", "height")], float)
    ids, sure = np.array(rows["det_id"], np.int64), np.array(rows["confidence"], float)
    tracks, last = np.array(list(live), np.int64), np.array([b[:4] for b in live.values()], float).reshape(-1, 4).T
    out: list[tuple[int, int]] = []
    taken = np.zeros_like(tracks, bool)
    for low, high in ((cfg.track_high, 2.0), (cfg.track_low, cfg.track_high)):
        part = np.flatnonzero((sure >= low) & (sure < high))
        done = np.zeros_like(part, bool)
        for i, t in _greedy(box[:, part], ids[part], last, tracks, done, taken, 1 - cfg.match_cost):
            out.append((int(part[i]), int(tracks[t])))
        new = part[~done & (sure[part] >= cfg.new_track)].tolist()
        started = {int(ids[i]) for i in new}
        taken |= np.fromiter((t in started for t in live), bool, len(live))
        out += [(i, int(ids[i])) for i in new]
    moved = box.T.tolist()
    for i, t in out:
        live[t] = (*moved[i], frame)
    return [(int(ids[i]), t) for i, t in out]


#: Pairs of boxes and tracks that are looked through at once.
OVERLAPS_AT_ONCE = 1 << 12
#: By how much the overlap that pairs must have goes down at a time, where this many boxes times tracks are left.
STEP, CROWD = 0.05, 1 << 20


def _greedy(box: np.ndarray, ids: np.ndarray, last: np.ndarray, tracks: np.ndarray, done: np.ndarray, taken: np.ndarray, floor: float) -> Iterator[tuple[int, int]]:
    """Places of boxes and tracks in order of their intersection over union (``floor`` or more), ties by id, each box and track once; ``done`` and ``taken`` mark them.

    Pairs of high overlap are found first.  What they take is left out before pairs of
    the next lower overlaps are looked for, so few of the overlaps of a crowd are ever kept.
    """
    sound = lambda b: np.isfinite(b).all(axis=0) & (b[2] > 0) & (b[3] > 0)
    mine, theirs, least = sound(box), sound(last), 1.0
    while least > floor:
        open_, free = np.flatnonzero(mine & ~done), np.flatnonzero(theirs & ~taken)
        least = max(least - STEP, floor) if len(open_) * len(free) > CROWD else floor
        if not len(open_) or not len(free):
            return
        found = overlaps.above(overlaps.Boxes(*box[:, open_], open_), overlaps.Boxes(*last[:, free], free), least)
        share, i, t = (np.concatenate(v) for v in zip((np.zeros(0), *np.zeros((2, 0), np.int64)), *found, strict=True))
        order = np.lexsort((tracks[t], ids[i], -share))
        for at in range(0, len(order), OVERLAPS_AT_ONCE):
            some = order[at : at + OVERLAPS_AT_ONCE]
            some = some[~done[i[some]] & ~taken[t[some]]]
            for own, track in zip(i[some].tolist(), t[some].tolist(), strict=True):
                if not done[own] and not taken[track]:
                    done[own] = taken[track] = True
                    yield own, track


class _Linked(InFrameOrder):
    """A live track is an entry of map state, written when it changes and removed when it ends."""

    def __init__(self, schema, out, keeps_ms, cfg):
        super().__init__(schema, out, keeps_ms)
        self.cfg = cfg

    def setup(self, handle):
        self.tracks = handle.getMapState("tracks", "track bigint", "x double, y double, width double, height double, frame bigint")

    def begin(self, key):
        self.live = {k[0]: tuple(v) for k, v in self.tracks.iterator()}
        self.stored = dict(self.live)

    def step(self, key, frame, rows):
        for det, track in link_frame(frame, rows, self.live, self.cfg):
            yield (key[0], det, track)

    def end(self, key):
        for t in self.stored.keys() - self.live.keys():
            self.tracks.removeKey((t,))
        for t, b in self.live.items():
            if self.stored.get(t) != b:
                self.tracks.updateValue((t,), b)

    def forget(self):
        self.tracks.clear()


LINKS = "video_id bigint, det_id bigint, track_id bigint"


def online_links(df: DataFrame, cfg: TrackerConfig = TrackerConfig(), late: str = "5 seconds") -> DataFrame:
    """ST5: det_id, track_id as frames complete: greedy best overlap with the tracks seen in the last ``buffer_frames`` frames.

    The state holds one box a live track, so it is bounded by the players in a
    picture, and the boxes that wait.  A video's state ends ``buffer_frames``
    past its last box: no track could go on by then.
    """
    return ordered(df, ["video_id"], _Linked, StructType.fromDDL(LINKS), late, f"{1000 * cfg.buffer_frames / cfg.fps} milliseconds", cfg=cfg)


def batch_links(df: DataFrame, cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    """The same of a whole table: videos are sorted within tasks and read frame by frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, live, now, rows = None, {}, None, None

        def finish() -> pd.DataFrame:
            made = link_frame(now[1], rows, live, cfg)
            return pd.DataFrame([(now[0], d, t) for d, t in made], columns=["video_id", "det_id", "track_id"]).astype("int64")

        for pdf in batches:
            for at, part in pdf.groupby(["video_id", "frame_id"], sort=False):
                if now is not None and at != now:
                    yield finish()
                    rows = None
                if at[0] != video:
                    video, live = at[0], {}
                columns = {c: part[c].tolist() for c in ("det_id", "x", "y", "width", "height", "confidence")}
                rows = columns if rows is None else {c: rows[c] + v for c, v in columns.items()}
                now = at
        if now is not None:
            yield finish()

    return df.repartition("video_id").sortWithinPartitions("video_id", "frame_id", "det_id").mapInPandas(run, LINKS)
