"""Paths as routes of a fixed number of points in the unit square."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RouteConfig
from ..functions import arrays as a
from ..functions import geometry as g
from .tracks import TRACK, drop_short_tracks


def normalize_coords(df: DataFrame, videos: DataFrame, cfg: RouteConfig = RouteConfig()) -> DataFrame:
    """Centres as shares of the picture, y upward, clipped to 0..1.

    Without a video's size the defaults hold; a height that is only assumed
    leaves y downward.
    """
    size = videos.select("video_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    rows = df.join(size, "video_id", "left")
    w, h = F.coalesce(F.when(F.col("_w") > 0, F.col("_w")), F.lit(cfg.width)), F.col("_h")
    nx = g.clip(g.center_x() / w)
    ny = g.clip(F.when(h > 0, 1 - g.center_y() / h).otherwise(g.center_y() / cfg.height))
    return rows.withColumns({"nx": nx, "ny": ny}).drop("_w", "_h")


def normalized_routes(df: DataFrame, videos: DataFrame, cfg: RouteConfig = RouteConfig()) -> DataFrame:
    """Each long enough track as ``points`` places equally far along its path."""
    rows = normalize_coords(drop_short_tracks(df, cfg.min_points), videos, cfg)
    path = rows.groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct("frame_id", "det_id", "nx", "ny"))).alias("p"), F.count("*").alias("original_num_detections"))
    x, y = F.transform("p", lambda s: s["nx"]), F.transform("p", lambda s: s["ny"])
    even = a.resample(F.col("x"), F.col("y"), cfg.points)
    out = path.select(*TRACK, "original_num_detections", x.alias("x"), y.alias("y")).withColumn("r", even)
    return out.select(*TRACK, "original_num_detections", F.col("r.x").alias("x_coords"), F.col("r.y").alias("y_coords"))


def flip_routes(routes: DataFrame) -> DataFrame:
    """The routes and their mirror images (y to 1 - y)."""
    mirrored = routes.withColumn("y_coords", F.transform("y_coords", lambda v: 1 - v))
    return routes.withColumn("flipped", F.lit(False)).unionByName(mirrored.withColumn("flipped", F.lit(True)))


def mirror_about(y: F.Column, y0: F.Column, flag: F.Column) -> F.Column:
    """Y to 2 y0 - y where flagged."""
    return F.when(flag, F.transform(y, lambda v: 2 * y0 - v)).otherwise(y)


def padded(routes: DataFrame, n: int = 64) -> DataFrame:
    """Both coordinate arrays cut or continued to ``n`` entries."""
    return routes.withColumns({c: a.pad_edge(F.col(c), n) for c in ("x_coords", "y_coords")})


def feature_vector(routes: DataFrame, n: int = 64) -> DataFrame:
    """One vector of x then y for learning."""
    from pyspark.ml.functions import array_to_vector

    return padded(routes, n).withColumn("features", array_to_vector(F.concat("x_coords", "y_coords")))


def augment_geometry(routes: DataFrame, degrees: float = 8.0, seed: int = 1) -> DataFrame:
    """P10: training routes flipped with a chance of one half and turned by up to ``degrees`` about the middle, by hash of the route."""
    from ..functions.hashing import between, uniform

    flip = uniform("flip", "route_id", seed=seed) < 0.5
    turn = F.radians(between(uniform("turn", "route_id", seed=seed), -degrees, degrees))
    rows = routes.withColumns({"_flip": flip, "_c": F.cos(turn), "_s": F.sin(turn)})
    rows = rows.withColumn("x_coords", F.when(F.col("_flip"), F.transform("x_coords", lambda v: 1 - v)).otherwise(F.col("x_coords")))
    x = F.zip_with("x_coords", "y_coords", lambda p, q: F.col("_c") * (p - 0.5) - F.col("_s") * (q - 0.5) + 0.5)
    y = F.zip_with("x_coords", "y_coords", lambda p, q: F.col("_s") * (p - 0.5) + F.col("_c") * (q - 0.5) + 0.5)
    return rows.withColumns({"_x": x, "_y": y}).withColumns({"x_coords": F.col("_x"), "y_coords": F.col("_y")}).drop("_flip", "_c", "_s", "_x", "_y")


def route_pixels(routes: DataFrame, size: int = 64, pad: int = 5, line: int = 2, disc: int = 3) -> DataFrame:
    """Pixels of each route's picture: route_id, row, col, channel (line, start or end).

    Ends are discs, which win over the line; a later kind wins over an earlier.
    """
    scale = size - 2 * pad
    pixel = lambda v: F.least(F.greatest(F.floor(v * scale + pad).cast("int"), F.lit(0)), F.lit(size - 1))
    points = F.zip_with(F.transform("x_coords", pixel), F.transform("y_coords", lambda v: pixel(1 - v)), lambda c, r: F.struct(c.alias("c"), r.alias("r")))
    p = routes.select("route_id", points.alias("p"))
    segment = p.select("route_id", F.posexplode(F.when(F.size("p") > 1, F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))).alias("i", "a"), "p")
    segment = segment.withColumn("b", F.element_at("p", F.least(F.col("i") + 2, F.size("p"))))
    steps = F.greatest(F.abs(F.col("b.c") - F.col("a.c")), F.abs(F.col("b.r") - F.col("a.r")), F.lit(1))
    walk = segment.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda f: F.round(F.col(f"a.{f}") + (F.col(f"b.{f}") - F.col(f"a.{f}")) * F.col("k") / F.col("n")).cast("int")
    thick = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(line) for j in range(line))))
    body = walk.select("route_id", at("r").alias("r"), at("c").alias("c"), thick.alias("o")).select("route_id", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), F.lit(1).alias("kind"))
    ring = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-disc, disc + 1) for j in range(-disc, disc + 1) if i * i + j * j <= disc * disc)))
    ends = p.select("route_id", F.explode(F.array(F.struct(F.element_at("p", 1).alias("p"), F.lit(2).alias("kind")), F.struct(F.element_at("p", -1).alias("p"), F.lit(3).alias("kind")))).alias("e")).select("route_id", "e.*", ring.alias("o"))
    ends = ends.select("route_id", (F.col("p.r") + F.col("o.i")).alias("r"), (F.col("p.c") + F.col("o.j")).alias("c"), "kind")
    inside = F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)
    names = F.when(F.col("kind") == 1, "line").when(F.col("kind") == 2, "start").otherwise("end")
    return body.unionByName(ends).where(inside).groupBy("route_id", "r", "c").agg(F.max("kind").alias("kind")).select("route_id", "r", "c", names.alias("channel"))


def heatmap(routes: DataFrame, cells: int = 64) -> DataFrame:
    """Points of all routes in each cell of a grid."""
    cell = lambda v: F.least(F.floor(v * cells).cast("int"), F.lit(cells - 1))
    points = routes.select(F.explode(F.arrays_zip("x_coords", "y_coords")).alias("p"))
    return points.groupBy(cell(F.col("p.x_coords")).alias("cx"), cell(F.col("p.y_coords")).alias("cy")).agg(F.count("*").alias("n"))
