"""Boxes within a frame: filters, overlaps, suppression, area stability."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FilterConfig, TrackerConfig
from ..functions import geometry as g
from ..functions.arrays import let
from ..storage import materialize
from . import overlaps


def bbox_geometry(df: DataFrame) -> DataFrame:
    """Centre, area, corners and aspect of each box."""
    return df.withColumns({"center_x": g.center_x(), "center_y": g.center_y(), "area": g.area(), "x2": F.col("x") + F.col("width"), "y2": F.col("y") + F.col("height"), "aspect": g.aspect()})


def filter_detections(df: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """boxes of plausible confidence, size, shape and height in the picture; bounds are inclusive."""
    return df.where((F.col("confidence") >= cfg.min_confidence) & g.area().between(cfg.area.low, cfg.area.high) & g.aspect().between(cfg.aspect.low, cfg.aspect.high) & F.col("y").between(cfg.top_y.low, cfg.top_y.high))


def _by_zone(y: Column, near, far, mid, cfg: FilterConfig) -> Column:
    """One of three values by the height of the box's centre."""
    return F.when(y >= cfg.near_y, near).when(y <= cfg.far_y, far).otherwise(mid)


def zone(cfg: FilterConfig = FilterConfig()):
    """near, mid or far by the height of the box's centre."""
    return _by_zone(g.center_y(), "near", "far", "mid", cfg)


def zone_filter(df: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """each zone has its own bounds of area and aspect."""
    inside = lambda b, name: b["area"].between(getattr(cfg, f"{name}_area").low, getattr(cfg, f"{name}_area").high) & b["aspect"].between(getattr(cfg, f"{name}_aspect").low, getattr(cfg, f"{name}_aspect").high)
    # Each measure is named once: a filter repeats what its columns are made of, and too long a compiled loop stays interpreted.
    box = F.struct(g.center_y().alias("y"), g.area().alias("area"), g.aspect().alias("aspect"))
    return df.where(let(box, lambda b: _by_zone(b["y"], inside(b, "near"), inside(b, "far"), inside(b, "mid"), cfg)))


def class_conf_filter(df: DataFrame, classes: tuple[int, ...] = (0,), threshold: float = 0.25) -> DataFrame:
    """wanted classes with enough confidence."""
    return df.where(F.col("class_id").isin(*classes) & (F.col("confidence") >= threshold))


def ghost_filter(df: DataFrame, cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    """drop boxes that the tracker would not trust."""
    return df.where(F.col("confidence") >= cfg.track_low)


def limit_frames(df: DataFrame, n: int) -> DataFrame:
    """frames before ``n``; reaches the scan as a pushed filter."""
    return df.where(F.col("frame_id") < n)


def sample_every_n(df: DataFrame, n: int = 10, most: int = 500) -> DataFrame:
    """distinct frames 0, n, 2n, ... of each video, at most ``most``."""
    frames = df.where(F.col("frame_id") % n == 0).select("video_id", "frame_id").distinct()
    return frames.withColumn("k", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_id"))).where(F.col("k") <= most).drop("k")


_BOX = ("x", "y", "width", "height")


#: A tile in which boxes meet is so many grid cells wide and high; so many boxes are compared with the others of a tile in one group.
TILE, BOXES_A_GROUP = 4, 65_536


def blocked(a: DataFrame, b: DataFrame | None, keys: list[str], cell: float | None) -> DataFrame:
    """Boxes (``id``, x, y, width, height, ...) dealt to the tiles of the picture that they touch, ``a`` marked ``_own``.

    Two boxes that overlap and agree in ``keys`` meet in a tile, among others in
    that of their intersection's corner.  A tile with many boxes of ``a`` is dealt
    to several groups (``_part``), all boxes of ``b`` to each.  Without ``b`` boxes of
    ``a`` meet each other: each is ``_own`` in one group and sent to all.  Without
    ``cell`` a frame is one tile.  Boxes without size or place overlap nothing and are left out.
    """
    across = lambda c, w: F.explode(F.sequence(F.floor(F.col(c) / (TILE * cell)), F.floor((F.col(c) + F.col(w)) / (TILE * cell)))) if cell else F.lit(0).cast("bigint")
    sound = " AND ".join([*(f"{k} IS NOT NULL" for k in [*keys, "id"]), "abs(x) < double('infinity')", "abs(y) < double('infinity')", "width > 0 AND x + width < double('infinity')", "height > 0 AND y + height < double('infinity')"])
    spread = lambda df: df.where(sound).withColumn("_cx", across("x", "width")).withColumn("_cy", across("y", "height"))
    place = [*keys, "_cx", "_cy"]
    a = spread(a)
    full = a.groupBy(*place).agg(F.ceil(F.count("*") / BOXES_A_GROUP).alias("_groups")).where("_groups > 1")
    dealt = lambda df: df.join(F.broadcast(full), place, "left").withColumn("_groups", F.coalesce("_groups", F.lit(1).cast("bigint")))  # noqa: E731  # at most a row for each BOXES_A_GROUP boxes
    every, turn = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_groups") - 1)), F.pmod(F.xxhash64("id"), F.col("_groups"))
    if b is None:
        return dealt(a).withColumn("_part", every).withColumn("_own", F.col("_part") == turn).drop("_groups")
    rows = dealt(a).withColumn("_part", turn).withColumn("_own", F.lit(True))
    return rows.unionByName(dealt(spread(b)).withColumn("_part", every).withColumn("_own", F.lit(False))).drop("_groups")


def meet(rows: DataFrame, keys: list[str], group: Callable[..., Iterator[pa.RecordBatch]], schema: str, *args) -> DataFrame:
    """``group(batches, keys, *args)`` on each group of boxes that :func:`blocked` has made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from group(batches, keys, *args)

    place = [*keys, "_cx", "_cy", "_part"]
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)  # few bytes, much work: not to be coalesced
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.groupBy(*place).applyInArrow(run, f"{types}, {schema}")


#: Equal boxes of a frame are compared as one; a row holds so many of their ids.
COPIES_A_ROW = 256


def _classes(df: DataFrame) -> DataFrame:
    """Equal boxes of a frame as rows of at most ``COPIES_A_ROW`` ids (``ids``, ascending), numbered by ``part``."""
    same = ["video_id", "frame_id", *_BOX]
    place = F.row_number().over(Window.partitionBy(*same).orderBy("det_id")) - 1
    rows = df.select("det_id", *same).where("det_id IS NOT NULL").withColumn("part", F.floor(place / COPIES_A_ROW))
    return rows.groupBy(*same, "part").agg(F.sort_array(F.collect_list("det_id")).alias("ids"))


def overlap_pairs(df: DataFrame, threshold: float, cell: float | None = FilterConfig.overlap_cell, digits: int | None = None, areas: bool = True) -> DataFrame:
    """Pairs of boxes (det_a < det_b) of one frame with an intersection over union above ``threshold``, which must not be negative.

    Boxes meet in tiles of some grid cells; with ``cell=None`` all boxes of a frame
    meet.  Equal boxes are compared once and their pairs made afterwards, inside the
    tile, and leave it in batches: boxes are shuffled, pairs are not.  ``digits`` rounds
    the overlap where it is made, once for all copies; ``areas`` adds area_a and area_b.
    """
    keys = ["video_id", "frame_id"]
    classes = materialize(_classes(df).withColumn("id", F.monotonically_increasing_id()), "boxes")
    schema = f"det_a bigint, det_b bigint, {'area_a double, area_b double, ' if areas else ''}iou double"
    return meet(blocked(classes.drop("part"), None, keys, cell), keys, overlaps.pairs_of_tile, schema, threshold, cell and TILE * cell, digits, areas)


def _dominated(df: DataFrame, threshold: float) -> DataFrame:
    """Boxes that a larger one overlaps, or an equally large one of a lower id; equal boxes are compared as one and pairs are not kept."""
    keys = ["video_id", "frame_id"]
    same = [*keys, *_BOX]
    classes = materialize(df.where("det_id IS NOT NULL").groupBy(*same).agg(F.min("det_id").alias("id")), "boxes")
    tiles = meet(blocked(classes, None, keys, FilterConfig.overlap_cell), keys, overlaps.larger_of_tile, "id bigint, larger boolean, least bigint", threshold)
    fate = tiles.groupBy(*keys, "id").agg(F.max("larger").alias("_larger"), F.min("least").alias("_least"))
    # Without a larger one, all that overlap here are equally large, this class among them.
    fate = classes.join(fate, [*keys, "id"]).drop("id")
    return df.select("det_id", *same).join(fate, same).where(F.col("_larger") | (F.col("det_id") > F.col("_least"))).select("video_id", "frame_id", "det_id")


def suppress_overlaps(df: DataFrame, threshold: float = 0.45, mode: str = "dominance") -> DataFrame:
    """Drop boxes that a larger one of their frame overlaps.

    ``dominance``: a box goes if any overlapping box is larger (ties: has the
    lower id).  ``greedy`` scans boxes by id: the scanned box drops smaller
    overlapping ones, and dies when it meets a larger one, whose box goes on
    with the scan.  A task of the greedy mode holds the boxes of one frame and
    finds the overlaps of a box when it scans; no pairs are kept.
    """
    if mode == "dominance":
        return df.join(_dominated(df, threshold).distinct(), ["video_id", "frame_id", "det_id"], "left_anti").select(*df.columns)
    if mode != "greedy":
        raise ValueError("mode must be dominance or greedy")

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        ids = pdf["det_id"].to_numpy()
        x, y, w, h = (pdf[c].to_numpy(float) for c in _BOX)
        right, low, area, widest = x + w, y + h, w * h, w.max(initial=0.0)
        gone = np.zeros(len(ids), bool)
        for i in np.argsort(ids, kind="stable"):
            if gone[i]:
                continue
            held, at = i, ids[i]
            while held is not None:
                # Boxes whose left side is so far left or right don't reach the held one.
                a, b = np.searchsorted(x, x[held] - widest - 1), np.searchsorted(x, right[held] + 1)
                open_ = a + np.flatnonzero((ids[a:b] > at) & ~gone[a:b])
                common = np.maximum(np.minimum(right[open_], right[held]) - np.maximum(x[open_], x[held]), 0.0) * np.maximum(np.minimum(low[open_], low[held]) - np.maximum(y[open_], y[held]), 0.0)
                union = area[open_] + area[held] - common
                near = open_[np.divide(common, union, out=np.zeros_like(common), where=union > 0) > threshold]
                larger = near[area[near] > area[held]]
                if not len(larger):
                    gone[near] = True
                    held = None
                else:
                    held = larger[np.argmin(ids[larger])]
                    at = ids[held]
                    gone[near[ids[near] < at]] = True
                    gone[i] = True
        return pdf.loc[gone, ["video_id", "frame_id", "det_id"]]

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("video_id", "frame_id", "det_id"))
    gone = df.select("video_id", "frame_id", "det_id", *_BOX).dropna().groupBy("video_id", "frame_id").applyInPandas(frame, schema)
    return df.join(gone, ["video_id", "frame_id", "det_id"], "left_anti").select(*df.columns)


def constrain_area(df: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """A box much larger than the recent mean of its grid cell shrinks to that mean about its centre.

    The mean is over the last boxes as already adjusted, so a cell is worked
    through in order (frame, id); cells are independent and run in parallel.  A
    task holds one Arrow batch and the last areas of one cell.
    """
    cells = df.withColumn("_gx", F.floor(g.center_x() / cfg.grid)).withColumn("_gy", F.floor(g.center_y() / cfg.grid))

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        recent: list[float] = []
        for pdf in batches:
            rows = []
            for *key, x, y, w, h in pdf[["video_id", "_gx", "_gy", *_BOX]].itertuples(index=False):
                cell = tuple(None if pd.isna(v) else v for v in key)
                if cell != now:
                    now, recent = cell, []
                x, y, w, h, recent = shrink(x, y, w, h, recent, cfg)
                rows.append((x, y, w, h))
            if rows:
                pdf[list(_BOX)] = rows
                yield pdf.drop(columns=["_gx", "_gy"])

    keys = ["video_id", "_gx", "_gy"]
    dealt = cells.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("frame_id"), F.asc_nulls_last("det_id"))
    return dealt.mapInPandas(in_order, df.schema)


def shrink(x: float, y: float, w: float, h: float, recent: list[float], cfg: FilterConfig) -> tuple[float, float, float, float, list[float]]:
    """One step of :func:`constrain_area`: the adjusted box and the areas to remember."""
    if recent:
        mean = sum(recent) / len(recent)
        if mean > 0 and w * h / mean > cfg.area_jump:
            scale = math.sqrt(mean / (w * h))
            x, y, w, h = x + (w - w * scale) / 2, y + (h - h * scale) / 2, w * scale, h * scale
    return x, y, w, h, [*recent, w * h][-cfg.area_history :]


def detections_by_frame(df: DataFrame) -> DataFrame:
    """The boxes of each frame as an array, by track and id."""
    return df.groupBy("video_id", "frame_id").agg(F.sort_array(F.collect_list(F.struct("track_id", "det_id", *_BOX))).alias("boxes"))
