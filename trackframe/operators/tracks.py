"""Tracks: measures, windows along time, filters on whole tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def along():
    """One window specification for all operators along a track, so Spark sorts once."""
    return Window.partitionBy("video_id", "track_id").orderBy("frame_id", "det_id")


TRACK = ("video_id", "track_id")


def one_per_frame(df: DataFrame) -> DataFrame:
    """The first box of a track in each frame."""
    w = Window.partitionBy("video_id", "track_id", "frame_id").orderBy("det_id")
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def with_steps(df: DataFrame) -> DataFrame:
    """Distance of each centre from the one before (null for the first)."""
    cx, cy = g.center_x(), g.center_y()
    return df.withColumn("step", g.distance(F.lag(cx).over(along()), F.lag(cy).over(along()), cx, cy))


def track_summary(df: DataFrame) -> DataFrame:
    """A1: a row for each track: counts, frames, distance, displacement, first and last centre."""
    order = F.struct("frame_id", "det_id")
    point = F.struct(g.center_x().alias("x"), g.center_y().alias("y"))
    out = with_steps(df).groupBy(*TRACK).agg(
        F.count("*").alias("num_detections"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_distance"), F.min_by(point, order).alias("p"), F.max_by(point, order).alias("q"),
    )
    out = out.select(*TRACK, "num_detections", "first_frame", "last_frame", "total_distance", F.col("p.x").alias("first_x"), F.col("p.y").alias("first_y"), F.col("q.x").alias("last_x"), F.col("q.y").alias("last_y"))
    return out.withColumn("displacement", g.distance(F.col("first_x"), F.col("first_y"), F.col("last_x"), F.col("last_y")))


def store_stats(df: DataFrame) -> DataFrame:
    """A2: tracks, detections and detections a track of each video."""
    per = df.groupBy(*TRACK).agg(F.count("*").alias("n"))
    return per.groupBy("video_id").agg(F.count("*").alias("num_tracks"), F.sum("n").alias("num_detections"), F.avg("n").alias("mean_detections"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """A3: one row over all videos."""
    per = store_stats(df)
    return per.agg(F.count("*").alias("num_videos"), F.coalesce(F.sum("num_tracks"), F.lit(0)).alias("num_tracks"), F.coalesce(F.sum("num_detections"), F.lit(0)).alias("num_detections"), F.coalesce(F.avg("num_tracks"), F.lit(0.0)).alias("tracks_per_video"))


def dataset_rollup(df: DataFrame) -> DataFrame:
    """A2 and A3 in one pass: a row for each video and one (null video) over all."""
    per = df.groupBy(*TRACK).agg(F.count("*").alias("n"))
    return per.rollup("video_id").agg(F.count("*").alias("num_tracks"), F.sum("n").alias("num_detections"))


def funnel_stats(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """A4: how many rows of each video a filter keeps; ratios are 0 where nothing came in."""
    a = raw.groupBy("video_id").agg(F.count("*").alias("raw"), F.countDistinct("frame_id").alias("frames"))
    b = kept.groupBy("video_id").agg(F.count("*").alias("filtered"))
    out = a.join(b, "video_id", "left").withColumn("filtered", F.coalesce("filtered", F.lit(0)))
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    return out.select("video_id", "raw", "filtered", ratio("filtered", "raw").alias("filter_ratio"), ratio("filtered", "frames").alias("per_frame"))


def field_position(df: DataFrame, width: float = 1920.0, height: float = 984.0) -> DataFrame:
    """Where a track starts and ends as shares of the picture, and its main direction.

    Two readings of the direction are given; a single point counts as 0.5 and unknown.
    """
    s = track_summary(df)
    one = F.col("num_detections") < 2
    share = lambda c, m: F.when(one, 0.5).otherwise(F.col(c) / m)
    dx, dy = F.col("last_x") - F.col("first_x"), F.col("last_y") - F.col("first_y")
    return s.select(
        *TRACK, share("first_x", width).alias("start_x"), share("first_y", height).alias("start_y"), share("last_x", width).alias("end_x"), share("last_y", height).alias("end_y"),
        dx.alias("dx"), dy.alias("dy"),
        F.when(one, "unknown").when(F.abs(dx) >= F.abs(dy), "vertical").otherwise("horizontal").alias("direction_by_length"),
        F.when(one, "unknown").when(F.abs(dy) >= F.abs(dx), "vertical").otherwise("horizontal").alias("direction_by_picture"),
    )


def velocities(df: DataFrame, fps: float = 30.0) -> DataFrame:
    """Velocity and speed between neighbouring rows in pixels a second; the first row of a track is dropped."""
    cx, cy = g.center_x(), g.center_y()
    dt = (F.col("frame_id") - F.lag("frame_id").over(along())) / F.lit(fps)
    out = df.withColumns({"_dt": dt, "_dx": cx - F.lag(cx).over(along()), "_dy": cy - F.lag(cy).over(along())}).where("_dt > 0")
    out = out.select(*df.columns, (F.col("_dx") / F.col("_dt")).alias("vx"), (F.col("_dy") / F.col("_dt")).alias("vy"))
    return out.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def arc_length(df: DataFrame) -> DataFrame:
    """Share of the track's length up to each row (0 for a track that does not move)."""
    run = F.sum(F.coalesce("step", F.lit(0.0))).over(along().rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(F.coalesce("step", F.lit(0.0))).over(Window.partitionBy(*TRACK))
    return with_steps(df).withColumns({"arc": run, "_whole": whole}).withColumn("arc_share", F.when(F.col("_whole") > 0, F.col("arc") / F.col("_whole")).otherwise(0.0)).drop("_whole", "step")


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each track."""
    return df.withColumn("_k", F.row_number().over(along())).where(F.col("_k") <= n).drop("_k")


def fill_gaps(df: DataFrame, max_gap: int = 10) -> DataFrame:
    """Rows for missing frames of gaps up to ``max_gap``, interpolated, confidence 0, no detection id."""
    box = ("x", "y", "width", "height")
    nxt = {f"_n_{c}": F.lead(c).over(along()) for c in ("frame_id", *box)}
    gaps = df.withColumns(nxt).withColumn("_gap", F.col("_n_frame_id") - F.col("frame_id"))
    gaps = gaps.where(F.col("_gap").between(2, max_gap)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_gap").cast("int") - 1)))
    t = F.col("_k") / F.col("_gap")
    made = gaps.select("video_id", "track_id", F.lit(None).cast("bigint").alias("det_id"), (F.col("frame_id") + F.col("_k")).alias("frame_id"), *((F.col(c) + (F.col(f"_n_{c}") - F.col(c)) * t).alias(c) for c in box), F.lit(0.0).alias("confidence"))
    return df.select(*made.columns).unionByName(made)


def track_history(df: DataFrame, n: int = 30) -> DataFrame:
    """Frame where the track was first seen, and its last ``n`` centres at each row."""
    point = F.struct(g.center_x().alias("x"), g.center_y().alias("y"))
    return df.withColumns({"first_seen": F.min("frame_id").over(Window.partitionBy(*TRACK)), "history": F.collect_list(point).over(along().rowsBetween(-(n - 1), 0))})


def drop_short_tracks(df: DataFrame, n: int = 30) -> DataFrame:
    """Rows of tracks with at least ``n`` detections."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*TRACK))).where(F.col("_n") >= n).drop("_n")


def drop_off_field(df: DataFrame, min_x: float = 0, max_x: float = 1920, min_y: float = 50, max_y: float = 934, share: float = 0.25) -> DataFrame:
    """rows of tracks with at least ``share`` of their centres within bounds."""
    inside = (g.center_x().between(min_x, max_x) & g.center_y().between(min_y, max_y)).cast("int")
    return df.withColumn("_in", F.avg(inside).over(Window.partitionBy(*TRACK))).where(F.col("_in") >= share).drop("_in")


def active_at(summary: DataFrame, frame: int) -> DataFrame:
    """tracks whose frames span ``frame``."""
    return summary.where((F.col("first_frame") <= frame) & (F.col("last_frame") >= frame))


def flip_x(df: DataFrame, width: float = 1920.0) -> DataFrame:
    """Mirrored left to right."""
    return df.withColumn("x", F.lit(width) - F.col("x") - F.col("width"))


def to_flat(nested: DataFrame) -> DataFrame:
    """A row for each detection of nested trajectories, with its centre."""
    flat = nested.select("video_id", "track_id", F.explode("detections").alias("d")).select("video_id", "track_id", "d.*")
    return flat.withColumns({"center_x": g.center_x(), "center_y": g.center_y()})


def to_nested(df: DataFrame) -> DataFrame:
    """The detections of each track as an array in order."""
    item = F.struct("frame_id", "det_id", "x", "y", "width", "height", "confidence")
    return df.groupBy(*TRACK).agg(F.sort_array(F.collect_list(item)).alias("detections"))
