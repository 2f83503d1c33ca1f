"""Synthetic labelled routes.

A route is a few control points that depend on its class, start and sampled
parameters, spread evenly to 64 places, smoothed, and finished with noise.  All
random numbers are hashes of (seed, route id, purpose), so a route is the same
wherever and however often it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESET_COUNTS, ROUTE_TYPES
from ..functions import arrays as a
from ..functions.geometry import clip, lerp, toward_midfield, toward_sideline
from ..functions.hashing import between, normal, uniform

POINTS = 64


def generate_ids(spark: SparkSession, counts: tuple[int, ...] = PRESET_COUNTS) -> DataFrame:
    """A row for each route to make, numbered by class."""
    classes = spark.createDataFrame(list(zip(range(len(ROUTE_TYPES)), ROUTE_TYPES, counts, strict=True)), "class_index int, route_type string, n int")
    rows = classes.where("n > 0").select("class_index", "route_type", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return rows.select((F.col("class_index").cast("bigint") * 1_000_000_000 + F.col("k")).alias("route_id"), "route_type")


def route_params(ids: DataFrame, seed: int = 42) -> DataFrame:
    """G1: start, depth, width, cut, noise and smoothing of each route."""
    u = lambda what: uniform(what, "route_id", seed=seed)
    side = u("alignment")
    start_y = F.when(side < 1 / 3, between(u("start_y"), 0.05, 0.22)).when(side < 2 / 3, between(u("start_y"), 0.78, 0.95)).otherwise(between(u("start_y"), 0.35, 0.65))
    return ids.withColumns(
        {
            "start_x": between(u("start_x"), 0.0, 0.04), "start_y": start_y, "depth": between(u("depth"), 0.25, 0.60), "width": between(u("width"), 0.08, 0.20),
            "cut": between(u("cut"), 0.35, 0.65), "noise": between(u("noise"), 0.001, 0.004), "sigma": between(u("sigma"), 2.0, 3.5),
        }
    )


def control_points(params: DataFrame, seed: int = 42) -> DataFrame:
    """Arrays ``ctrl_x``, ``ctrl_y`` by route class."""
    sx, sy, d, c = (F.col(n) for n in ("start_x", "start_y", "depth", "cut"))
    mid, out = toward_midfield(sy), toward_sideline(sy)
    side = F.when(sy < 0.5, 0.0).otherwise(1.0)

    def u(what: str, low: float, high: float) -> Column:
        return between(uniform(what, "route_id", seed=seed), low, high)

    coin = F.when(uniform("coin", "route_id", seed=seed) < 0.5, -1.0).otherwise(1.0)
    coin2 = F.when(uniform("coin2", "route_id", seed=seed) < 0.5, -1.0).otherwise(1.0)

    def streak():
        ye, ex = clip(sy + coin * u("a", 0.02, 0.06)), sx + 1.6 * d
        return [sx, lerp(sx, ex, 0.4), ex], [sy, lerp(sy, ye, 0.5), ye]

    def slant():
        cx, ex = sx + d * clip(c + u("a", -0.55, 0.05), 0.25, 0.5), sx + d
        return [sx, lerp(sx, cx, 0.55), cx, ex], [sy, sy, sy, clip(sy + mid * u("b", 0.3, 0.55))]

    def post():
        cx, ex = sx + d * clip(0.75 + u("a", -0.04, 0.04), 0.65, 0.85), sx + 1.15 * d
        return [sx, lerp(sx, cx, 0.45), cx, ex], [sy, sy, sy, clip(sy + mid * u("b", 0.12, 0.30))]

    def corner():
        cx, ex = sx + d * clip(0.75 + u("a", -0.04, 0.04), 0.45, 0.65), sx + d
        return [sx, lerp(sx, cx, 0.45), cx, ex], [sy, sy, sy, sy + (side - sy) * u("b", 0.55, 0.80)]

    def drag():
        ex = sx + d * clip(0.35 + u("a", -0.10, 0.10), 0.2, 0.6)
        ye = clip(sy + 2.2 * (0.5 - sy))
        ye = F.when(F.abs(ye - sy) < 2 * (ex - sx), clip(sy + mid * 2 * (ex - sx))).otherwise(ye)
        return [sx, lerp(sx, ex, 0.3), lerp(sx, ex, 0.7), ex], [sy, lerp(sy, ye, 0.25), lerp(sy, ye, 0.7), ye]

    def curl():
        px, r, e = sx + 0.45 * d, d * u("a", 0.03, 0.09), mid * u("b", 0.02, 0.05)
        return [sx, px, px - 0.5 * r, px - r], [sy, sy, clip(sy + 0.3 * e), clip(sy + e)]

    def cutting(turn: Column, low: float, drift: tuple[float, float], reach: tuple[float, float]):
        cx = sx + d * clip(c + u("a", -0.05, 0.05), low, 0.85)
        ex, ye = cx + d * u("b", *drift), clip(sy + turn * u("e", *reach))
        return [sx, lerp(sx, cx, 0.5), cx, lerp(cx, ex, 0.35), ex], [sy, sy, sy, lerp(sy, ye, 0.55), ye]

    def comeback():
        long = d * u("a", 1.2, 1.4)
        px, yp, r = sx + 0.68 * long, clip(sy + coin * u("b", 0.015, 0.05)), long * u("e", 0.15, 0.25)
        yr = clip(yp + coin2 * u("f", 0.02, 0.06))
        return [sx, lerp(sx, px, 0.4), px, px - 0.4 * r, px - 0.75 * r, px - r], [sy, lerp(sy, yp, 0.5), yp, lerp(yp, yr, 0.3), lerp(yp, yr, 0.7), yr]

    def flat():
        ye, ex = sy + 0.5 * (side - sy), sx + 0.18 * d + d * u("a", -0.04, 0.10)
        steep = F.abs(ye - sy) < 2 * F.abs(ex - sx)
        ye = F.when(steep, clip(sy + out * 2 * F.abs(ex - sx))).otherwise(ye)
        flip = uniform("mirror", "route_id", seed=seed) < 0.5
        turned = lambda v: F.when(flip, 2 * sy - v).otherwise(v)
        return [sx, lerp(sx, ex, 0.40), ex], [turned(v) for v in (sy, lerp(sy, ye, 0.55), ye)]

    def wheel():
        long, q = 1.55 * d * u("a", 0.88, 1.12), clip(0.60 + u("b", -0.08, 0.10), 0.45, 0.85)
        mx, my, ex, ey = sx + 0.15 * long, sy + (side - sy) * q, sx + long, sy + 0.62 * (side - sy)
        return [sx, mx, lerp(sx, ex, 0.5), lerp(sx, ex, 0.8), ex], [sy, my, lerp(my, ey, 0.3), lerp(my, ey, 0.7), ey]

    shapes = {
        "streak": streak(), "slant": slant(), "post": post(), "corner": corner(), "drag": drag(), "curl": curl(),
        "dig": cutting(mid, 0.35, (-0.015, 0.03), (0.18, 0.32)), "out": cutting(out, 0.30, (-0.01, 0.03), (0.18, 0.32)),
        "comeback": comeback(), "flat": flat(), "wheel": wheel(),
    }
    xs = ys = F.lit(None).cast("array<double>")
    for name, (x, y) in shapes.items():
        here = F.col("route_type") == name
        xs, ys = F.when(here, F.array(*x)).otherwise(xs), F.when(here, F.array(*y)).otherwise(ys)
    return params.withColumns({"ctrl_x": xs, "ctrl_y": ys})


def finish(routes: DataFrame, seed: int = 42) -> DataFrame:
    """Noise, cut at the field's border, no way back in x (but for curl and comeback), clip."""
    point = lambda axis: lambda v, i: v + F.col("noise") * normal(uniform(f"n1{axis}", "route_id", i, seed=seed), uniform(f"n2{axis}", "route_id", i, seed=seed))
    noisy = a.let(F.struct(F.transform("x", point("x")).alias("x"), F.transform("y", point("y")).alias("y")), lambda p: a.truncate_at_boundary(p["x"], p["y"]))
    within = lambda v: F.transform(v, lambda e: clip(e))
    back = F.col("route_type").isin("curl", "comeback")
    done = a.let(noisy, lambda t: F.struct(within(F.when(back, t["x"]).otherwise(a.monotonic(t["x"]))).alias("x"), within(t["y"]).alias("y")))
    return routes.withColumn("_done", done).withColumns({"x_coords": F.col("_done.x"), "y_coords": F.col("_done.y")}).drop("_done", "x", "y")


def generate_dataset(spark: SparkSession, counts: tuple[int, ...] = PRESET_COUNTS, seed: int = 42) -> DataFrame:
    """route_id, route_type, x_coords, y_coords and params of each synthetic route."""
    return routes_of(generate_ids(spark, counts), seed)


def routes_of(ids: DataFrame, seed: int = 42) -> DataFrame:
    """The routes of given (route_id, route_type) rows; further columns stay, last.

    A row of some bytes makes much work, so rows are spread first: a small file would be one task.
    """
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = control_points(route_params(ids.repartition(tasks, "route_id"), seed), seed)
    even = rows.withColumns({"x": a.gaussian_smooth_by(a.interp_uniform(F.col("ctrl_x"), POINTS), F.col("sigma")), "y": a.gaussian_smooth_by(a.interp_uniform(F.col("ctrl_y"), POINTS), F.col("sigma"))})
    more = [c for c in ids.columns if c not in ("route_id", "route_type")]
    return finish(even, seed).select("route_id", "route_type", "x_coords", "y_coords", F.struct("start_x", "start_y", "depth", "width").alias("params"), *more)
