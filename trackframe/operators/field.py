"""Field orientation: angles of long lines, the dominant one, rotation and homography of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FieldConfig
from ..functions import geometry as g


def line_angles(segments: DataFrame, cfg: FieldConfig = FieldConfig()) -> DataFrame:
    """Angle 0..90 of each long enough segment and its bin (halves round to even)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turned = F.degrees(F.atan2(dy, dx))
    half = F.when(turned < 0, turned + 180).when(turned >= 180, turned - 180).otherwise(turned)
    angle = F.when(half >= 90, 180 - half).otherwise(half)
    long = segments.where(F.sqrt(dx * dx + dy * dy) >= cfg.min_length).withColumn("angle", angle)
    return long.withColumn("bin", (F.bround(F.col("angle") / cfg.bin_degrees) * cfg.bin_degrees).cast("bigint"))


def line_angle_histogram(segments: DataFrame, cfg: FieldConfig = FieldConfig()) -> DataFrame:
    """Lines in each bin, and the first of them."""
    return line_angles(segments, cfg).groupBy("video_id", "bin").agg(F.count("*").alias("lines"), F.min("line_id").alias("first_line"))


def dominant_angle(segments: DataFrame, cfg: FieldConfig = FieldConfig()) -> DataFrame:
    """A row for each video: angle, lines, confidence, whether it is valid.

    The fullest bin wins (ties: seen first).  If that is 0 and a bin of the
    line range has two lines at least, the range's mean bin is taken, weighted
    by lines (a single bin: itself).  Only angles in (0, 40] are valid; others,
    and fewer than two lines, mean no rotation.
    """
    hist = line_angle_histogram(segments, cfg)
    rank = F.struct(F.col("lines"), -F.col("first_line"))
    inside = F.col("bin").between(cfg.line_bins.low, cfg.line_bins.high)
    out = hist.groupBy("video_id").agg(
        F.sum("lines").alias("lines"), F.max_by("bin", rank).alias("top"),
        F.sum(F.when(inside, F.col("bin") * F.col("lines"))).alias("_sum"), F.sum(F.when(inside, F.col("lines"))).alias("_n"), F.max(F.when(inside, F.col("lines"))).alias("_most"),
    )
    angle = F.when((F.col("top") == 0) & (F.col("_most") >= 2), F.col("_sum") / F.col("_n")).otherwise(F.col("top").cast("double"))
    out = out.withColumn("line_angle", angle)
    valid = (F.col("lines") >= 2) & (F.col("line_angle") > 0) & (F.col("line_angle") <= cfg.valid_angle)
    all_videos = segments.select("video_id").distinct()
    out = all_videos.join(out, "video_id", "left").withColumn("valid", F.coalesce(valid, F.lit(False)))
    return out.select("video_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("line_angle", F.lit(0.0)).alias("line_angle"), "valid", F.when(F.col("valid"), F.col("line_angle")).otherwise(0.0).alias("rotation"), F.when(F.col("valid"), F.least(F.lit(1.0), F.col("lines") / F.lit(float(cfg.full_count)))).otherwise(0.0).alias("confidence"))


def rotate_about_center(df: DataFrame, angle: F.Column | str, width: float, height: float, sign: int = 1) -> DataFrame:
    """P5: box centres turned about the picture's centre by ``sign * angle`` degrees; boxes keep their size."""
    a = F.radians(F.col(angle) if isinstance(angle, str) else angle) * sign
    cx, cy = g.center_x() - width / 2, g.center_y() - height / 2
    x = F.cos(a) * cx - F.sin(a) * cy + width / 2
    y = F.sin(a) * cx + F.cos(a) * cy + height / 2
    return df.withColumns({"x": x - F.col("width") / 2, "y": y - F.col("height") / 2})


def rotate_field(df: DataFrame, orientation: DataFrame, width: float = 1920.0, height: float = 984.0, sign: int = 1) -> DataFrame:
    """Each video's boxes turned by its own rotation (one row a video; none: not turned)."""
    turn = orientation.select("video_id", F.col("rotation").alias("_turn"))
    rows = df.join(turn, "video_id", "left").withColumn("_turn", F.coalesce("_turn", F.lit(0.0)))
    return rotate_about_center(rows, "_turn", width, height, sign).select(*df.columns)


def apply_homography(df: DataFrame, h: tuple[float, ...]) -> DataFrame:
    """Centres through a 3x3 matrix (nine numbers, by rows); boxes keep their size about the new centre.

    Points at infinity (third coordinate within 1e-6 of 0) are not divided.
    """
    cx, cy = g.center_x(), g.center_y()
    u, v, w = (F.lit(h[3 * k]) * cx + F.lit(h[3 * k + 1]) * cy + F.lit(h[3 * k + 2]) for k in range(3))
    far = F.abs(w) > 1e-6
    return df.withColumns({"_u": F.when(far, u / w).otherwise(u), "_v": F.when(far, v / w).otherwise(v)}).withColumns({"x": F.col("_u") - F.col("width") / 2, "y": F.col("_v") - F.col("height") / 2}).drop("_u", "_v")


def field_depth(df: DataFrame) -> DataFrame:
    """Distance along and across the field from a track's first centre."""
    w = Window.partitionBy("video_id", "track_id").orderBy("frame_id", "det_id")
    return df.withColumns({"depth": g.center_x() - F.first(g.center_x()).over(w), "across": g.center_y() - F.first(g.center_y()).over(w)})
