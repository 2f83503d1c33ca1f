"""Camera motion: fit per frame, smoothing, accumulation, stabilised boxes.

A similarity between frames is a turn by ``theta``, a scale ``s`` and a shift
(dx, dy).  Seen as complex numbers, transforms multiply and shifts add up, so
the motion from frame 0 to t needs running sums only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MotionConfig
from ..storage import drop_tables, materialize

def frames():
    return Window.partitionBy("video_id").orderBy("frame_id")



def _fit(points: DataFrame, tag: str) -> DataFrame:
    """Least-squares similarity of each frame from sums over its matched points."""
    n, s = F.count("*"), lambda e: F.sum(F.expr(e))
    sums = points.groupBy("video_id", "frame_id").agg(
        n.alias("n"), s("px").alias("sx"), s("py").alias("sy"), s("cx").alias("su"), s("cy").alias("sv"),
        s("px*px+py*py").alias("ss"), s("px*cx+py*cy").alias("sd"), s("px*cy-py*cx").alias("sc"),
    )
    spread = F.expr("ss - (sx*sx+sy*sy)/n")
    a = F.when(spread > 0, F.expr("sd - (sx*su+sy*sv)/n") / spread)
    b = F.when(spread > 0, F.expr("sc - (sx*sv-sy*su)/n") / spread)
    out = sums.withColumns({"_a": a, "_b": b})
    return out.select("video_id", "frame_id", F.col("n").alias(f"n{tag}"), F.col("_a").alias("a"), F.col("_b").alias("b"), F.expr("(su - _a*sx + _b*sy)/n").alias("tx"), F.expr("(sv - _b*sx - _a*sy)/n").alias("ty"))


def fit_frame_motion(matches: DataFrame, cfg: MotionConfig = MotionConfig(), trims: int = 3) -> DataFrame:
    """Similarity of each frame by trimmed least squares.

    Each round refits on the points whose residual is at most the median of
    the round before or the inlier limit; the last fit is on inliers.  A frame
    passes if it has enough points and inliers, and scale and shift are sane;
    others get the identity (``ok`` false).  Fits are small and read several
    times, so each round writes its own; points are read anew and not shuffled
    unless there are very many frames.
    """
    keys = ["video_id", "frame_id"]
    first = fit = materialize(_fit(matches, ""), "motion-fit")
    error = F.sqrt(F.expr("pow(cx - (a*px - b*py + tx), 2) + pow(cy - (b*px + a*py + ty), 2)"))
    used = []
    for _ in range(trims):
        seen = matches.join(fit.drop("n"), keys).withColumn("error", error)
        middle = materialize(seen.groupBy(*keys).agg(F.percentile("error", F.lit(0.5)).alias("middle")), "motion-middle")
        points = seen.join(middle, keys).where(F.col("error") <= F.greatest("middle", F.lit(cfg.inlier_pixels))).select(*matches.columns)
        used += [fit, middle]
        fit = materialize(_fit(points, ""), "motion-fit")
    last = matches.join(fit.drop("n"), keys).withColumn("error", error)
    good = last.where(F.col("error") <= cfg.inlier_pixels).select(*matches.columns)
    counts = first.select(*keys, F.col("n").alias("points"))
    out = counts.join(_fit(good, "_in"), keys, "left").withColumns({"scale": F.expr("sqrt(a*a+b*b)"), "theta": F.expr("atan2(b, a)"), "inliers": F.coalesce("n_in", F.lit(0))})
    ok = (F.col("points") >= cfg.min_points) & (F.col("inliers") >= 2) & (F.col("inliers") / F.col("points") >= cfg.min_inliers) & F.col("scale").between(cfg.scale.low, cfg.scale.high) & (F.sqrt(F.expr("tx*tx+ty*ty")) <= cfg.max_shift)
    ok = F.coalesce(ok, F.lit(False))
    value = lambda c, other: F.when(F.col("ok"), F.col(c)).otherwise(other)
    out = out.withColumn("ok", ok).select(*keys, "points", F.col("inliers").cast("bigint").alias("inliers"), "ok", value("tx", 0.0).alias("dx"), value("ty", 0.0).alias("dy"), value("theta", 0.0).alias("theta"), F.ln(value("scale", 1.0)).alias("log_s"))
    out = materialize(out, "motion")
    drop_tables(*used, fit)
    return out


def smooth_motion(motion: DataFrame, cfg: MotionConfig = MotionConfig()) -> DataFrame:
    """Mean of the last frames that moved (angles on the circle, scales as logarithms); frames that hardly moved are the identity and are not remembered."""
    still = (F.sqrt(F.expr("dx*dx+dy*dy")) < cfg.still_pixels) & (F.abs(F.exp("log_s") - 1) < cfg.still_scale) & (F.abs("theta") < cfg.still_angle)
    rows = motion.withColumn("_still", still)
    w = frames().rowsBetween(-(cfg.window - 1), 0)
    keys = [c for c in ("video_id", "frame_id")]
    moved = rows.where("not _still").select(*keys, F.avg("dx").over(w).alias("dx"), F.avg("dy").over(w).alias("dy"), F.atan2(F.avg(F.sin("theta")).over(w), F.avg(F.cos("theta")).over(w)).alias("theta"), F.avg("log_s").over(w).alias("log_s"))
    zero = rows.where("_still").select(*keys, *(F.lit(0.0).alias(c) for c in ("dx", "dy", "theta", "log_s")))
    return moved.unionByName(zero)


def cumulative_transform(motion: DataFrame) -> DataFrame:
    """Similarity from frame 0 to each frame, and its inverse, as (a, b, tx, ty): x' = a x - b y + tx, y' = b x + a y + ty.

    With L and phi the running sums of log scale and angle, the shift is
    e^L R(phi) S, where S sums e^-L R(-phi) (dx, dy): three running sums.
    """
    w = frames().rowsBetween(Window.unboundedPreceding, 0)
    run = motion.withColumns({"_l": F.sum("log_s").over(w), "_p": F.sum("theta").over(w)})
    q = run.withColumns({"_qx": F.expr("exp(-_l)*(dx*cos(_p)+dy*sin(_p))"), "_qy": F.expr("exp(-_l)*(dy*cos(_p)-dx*sin(_p))")})
    s = q.withColumns({"_sx": F.sum("_qx").over(w), "_sy": F.sum("_qy").over(w)})
    return s.select(
        "video_id", "frame_id", F.expr("exp(_l)*cos(_p)").alias("a"), F.expr("exp(_l)*sin(_p)").alias("b"),
        F.expr("exp(_l)*(_sx*cos(_p)-_sy*sin(_p))").alias("tx"), F.expr("exp(_l)*(_sx*sin(_p)+_sy*cos(_p))").alias("ty"),
        F.expr("exp(-_l)*cos(_p)").alias("inv_a"), F.expr("-exp(-_l)*sin(_p)").alias("inv_b"), (-F.col("_sx")).alias("inv_tx"), (-F.col("_sy")).alias("inv_ty"),
    )


def motion_stats(motion: DataFrame) -> DataFrame:
    """A5: total pixels of motion of each video, and mean over the frames after the first."""
    total = F.sum(F.expr("sqrt(dx*dx+dy*dy)"))
    return motion.groupBy("video_id").agg(total.alias("total_motion"), F.coalesce(F.try_divide(total, F.count("*") - 1), F.lit(0.0)).alias("mean_motion"))


def transform_envelope(df: DataFrame) -> DataFrame:
    """Boxes whose corners go through (a, b, tx, ty); the box around the four images."""
    x = lambda p, q: F.expr(f"a*({p}) - b*({q}) + tx")
    y = lambda p, q: F.expr(f"b*({p}) + a*({q}) + ty")
    corners = [("x", "y"), ("x+width", "y"), ("x", "y+height"), ("x+width", "y+height")]
    xs, ys = [x(*c) for c in corners], [y(*c) for c in corners]
    low_x, low_y = F.least(*xs), F.least(*ys)
    out = df.withColumns({"_x": low_x, "_y": low_y, "_w": F.greatest(*xs) - low_x, "_h": F.greatest(*ys) - low_y})
    return out.withColumns({"x": F.col("_x"), "y": F.col("_y"), "width": F.col("_w"), "height": F.col("_h")}).drop("_x", "_y", "_w", "_h", "a", "b", "tx", "ty")


def stabilize(df: DataFrame, transforms: DataFrame) -> DataFrame:
    """Boxes moved back to frame 0's view; frames without a transform use the video's last one, videos without any stay."""
    inv = transforms.select("video_id", "frame_id", F.struct(F.col("inv_a").alias("a"), F.col("inv_b").alias("b"), F.col("inv_tx").alias("tx"), F.col("inv_ty").alias("ty")).alias("m"))
    last = inv.groupBy("video_id").agg(F.max_by("m", "frame_id").alias("_last"))
    rows = df.join(inv, ["video_id", "frame_id"], "left").join(last, "video_id", "left").withColumn("_m", F.coalesce("m", "_last"))
    one = {"a": 1.0, "b": 0.0, "tx": 0.0, "ty": 0.0}
    rows = rows.withColumns({c: F.coalesce(F.col(f"_m.{c}"), F.lit(v)) for c, v in one.items()}).drop("m", "_last", "_m")
    return transform_envelope(rows).select(*df.columns)
