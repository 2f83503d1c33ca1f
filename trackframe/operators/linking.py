"""Linking boxes of neighbouring frames into tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FilterConfig, TrackerConfig
from ..storage import drop_tables, materialize
from . import overlaps
from .detections import blocked, meet

_BOX = ("x", "y", "width", "height")


def link_detections(df: DataFrame, floor: float = 0.25, cell: float = FilterConfig.overlap_cell) -> DataFrame:
    """Pairs (det_a in frame t, det_b in t + 1) that are each other's best overlap, of at least ``floor`` (above 0); ties to the lower id.

    Of equal boxes of a frame only the lowest id can be linked.  Boxes meet in
    tiles, where the best of each is found by bounds, most promising first; what
    is shuffled is a row a box and tile, and no pairs.
    """
    keys = ["video_id", "frame_id"]
    boxes = materialize(df.where("det_id IS NOT NULL").groupBy(*keys, *_BOX).agg(F.min("det_id").alias("id")), "boxes")
    before = boxes.withColumn("frame_id", F.col("frame_id") + 1)
    found = meet(blocked(before, boxes, keys, cell), keys, overlaps.best_of_tile, "first boolean, id bigint, iou double, other bigint", floor)
    best = found.groupBy(*keys, "first", "id").agg(F.min(F.struct((-F.col("iou")).alias("less"), "other")).alias("best"))
    end = lambda own: F.when(F.col("first") == F.lit(own), F.col("id")).otherwise(F.col("best.other"))
    both = best.select(*keys, end(True).alias("det_a"), end(False).alias("det_b"), (-F.col("best.less")).alias("iou")).groupBy(*keys, "det_a", "det_b")
    return both.agg(F.count("*").alias("n"), F.max("iou").alias("iou")).where("n = 2").select(*keys, "det_a", "det_b", "iou")


def two_pass_links(df: DataFrame, cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Links among confident boxes first, then what is left to doubtful boxes."""
    floor = 1 - cfg.match_cost
    sure = df.where(F.col("confidence") >= cfg.track_high)
    first = materialize(link_detections(sure, floor), "links-first")
    has_next = first.select("video_id", F.col("det_a").alias("det_id"))
    has_last = first.select("video_id", F.col("det_b").alias("det_id"))
    weak = df.where((F.col("confidence") >= cfg.track_low) & (F.col("confidence") < cfg.track_high))
    open_ends = sure.join(has_next, ["video_id", "det_id"], "left_anti")
    second = link_detections(open_ends.unionByName(weak), floor)
    taken = second.join(has_last.withColumnRenamed("det_id", "det_b"), ["video_id", "det_b"], "left_anti")
    weak_ids = weak.select("video_id", F.col("det_id").alias("det_b"))
    return first.unionByName(taken.join(weak_ids, ["video_id", "det_b"], "left_semi").select(*first.columns))


def assign_track_ids(df: DataFrame, cfg: TrackerConfig = TrackerConfig()) -> DataFrame:
    """``track_id`` of each box: the id of its chain's first box.

    Each linked box points to its predecessor; pointers double each round, so a
    chain of n boxes takes log2(n) joins, of linked boxes only.  Chains whose first
    box is not confident enough for a new track are dropped.
    """
    links = two_pass_links(df, cfg).select("video_id", F.col("det_b").alias("det_id"), F.col("det_a").alias("root"))
    point = materialize(links, "chain")
    while True:
        up = point.select("video_id", F.col("det_id").alias("root"), F.col("root").alias("up"))
        after = materialize(point.join(up, ["video_id", "root"], "left").select("video_id", "det_id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "chain")
        done = after.where("moved").isEmpty()
        drop_tables(point)
        point = after.drop("moved")
        if done:
            break
    starts = df.where(F.col("confidence") >= cfg.new_track).select("video_id", F.col("det_id").alias("root"))
    begun = point.join(starts.withColumn("_begun", F.lit(True)).distinct(), ["video_id", "root"], "left")
    alone = F.col("root").isNull() & (F.col("confidence") >= max(cfg.new_track, cfg.track_low)) & F.col("video_id").isNotNull() & F.col("det_id").isNotNull()
    rows = df.join(begun, ["video_id", "det_id"], "left").where(alone | F.col("_begun"))
    return rows.withColumn("track_id", F.coalesce("root", "det_id")).drop("root", "_begun")
