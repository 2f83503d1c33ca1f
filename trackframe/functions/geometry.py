"""Column expressions on boxes and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center_x() -> Column:
    return F.col("x") + F.col("width") / 2


def center_y() -> Column:
    return F.col("y") + F.col("height") / 2


def area() -> Column:
    return F.col("width") * F.col("height")


def aspect() -> Column:
    """Width by height; 0 where the height is not positive."""
    return F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes whose columns have prefixes ``a`` and ``b``; 0 if the union is empty."""
    side = lambda p, c: F.col(f"{p}{c}")
    wide = F.least(side(a, "x") + side(a, "width"), side(b, "x") + side(b, "width")) - F.greatest(side(a, "x"), side(b, "x"))
    high = F.least(side(a, "y") + side(a, "height"), side(b, "y") + side(b, "height")) - F.greatest(side(a, "y"), side(b, "y"))
    common = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    union = side(a, "width") * side(a, "height") + side(b, "width") * side(b, "height") - common
    return F.when(union > 0, common / union).otherwise(0.0)


def lerp(a: Column, b: Column, t: float | Column) -> Column:
    return a + (b - a) * t


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def toward_midfield(y: Column) -> Column:
    """+1 or -1 toward the middle; the middle itself counts as +1."""
    return F.when(F.lit(0.5) - y < 0, -1.0).otherwise(1.0)


def toward_sideline(y: Column) -> Column:
    return F.when(y - 0.5 < 0, -1.0).otherwise(1.0)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def frames_to_seconds(frames: Column, fps: Column | float = 30.0) -> Column:
    return frames / fps
