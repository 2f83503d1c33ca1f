"""Hand labels: joining to routes, what is unlabelled, batches, holdouts and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ROUTE_TYPES
from ..functions.hashing import uniform

#: Rows that one task ranks; and how many ranges there are at most, as their sizes are broadcast (24 bytes each).
RANGE_ROWS, MOST_RANGES = 500_000, 1_000_000


def valid_labels(labels: DataFrame, classes: tuple[str, ...] = ROUTE_TYPES) -> DataFrame:
    """labels of known classes; those with coordinate columns must have both."""
    rows = labels.where(F.col("route_type").isin(*classes))
    for c in ("x_coords", "y_coords"):
        if c in labels.columns:
            rows = rows.where(F.col(c).isNotNull() & (F.size(c) > 0))
    return rows


def attach_coords(labels: DataFrame, routes: DataFrame) -> DataFrame:
    """Labels with the coordinates of their track; of several matches the first by route id."""
    w = Window.partitionBy("track_id", "source_video").orderBy("route_id")
    first = routes.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("track_id", "source_video", "x_coords", "y_coords")
    return labels.join(first, ["track_id", "source_video"])


def unlabelled(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Tracks that no label names."""
    return tracks.join(labels, ["track_id", "source_video"], "left_anti")


def label_batch(tracks: DataFrame, labels: DataFrame, n: int = 20, random: bool = True, seed: int = 42) -> DataFrame:
    """K4: the next ``n`` tracks to label, in hash order or in order of video and track."""
    rest = unlabelled(tracks, labels)
    order = [uniform("batch", "source_video", "track_id", seed=seed)] if random else []
    return rest.orderBy(*order, "source_video", "track_id").limit(n)


def stratified_holdout(labels: DataFrame, share: float = 0.2, seed: int = 42, key: str = "track_id") -> DataFrame:
    """``split`` by class: max(1, ceil(n * share)) go to the holdout; a class of one stays in training."""
    in_class = Window.partitionBy("route_type")
    rows = labels.withColumn("_u", uniform("holdout", key, seed=seed)).withColumns({"_n": F.count("*").over(in_class), "_k": F.row_number().over(in_class.orderBy("_u", key))})
    take = F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    return rows.withColumn("split", F.when((F.col("_n") > 1) & (F.col("_k") <= take), "holdout").otherwise("train")).drop("_u", "_n", "_k")


def random_split(rows: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.1), ("test", 0.1)), key: str = "route_id", seed: int = 42) -> DataFrame:
    """A split of exact sizes: rows in hash order, cut at int(n * share).

    Ranks come in two passes (within hash ranges, plus the sizes of the ranges
    before), so no single task sorts all rows.  Hashes are uniform, so ranges of
    equal width are of equal size; there is one for each ``RANGE_ROWS`` rows.
    Rows of one key share their hash and lie together.
    """
    parts = min(MOST_RANGES, -(-rows.count() // RANGE_ROWS) or 1)
    marked = rows.withColumn("_u", uniform("split", key, seed=seed)).withColumn("_p", F.floor(F.col("_u") * parts))
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_size"))
    before = sizes.select("_p", (F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(F.lit(1))).alias("_all"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_u", key)) - 1
    ranked = marked.withColumn("_r", rank).join(F.broadcast(before), "_p").withColumn("_r", F.col("_r") + F.col("_before"))
    split, edge = F.lit(shares[-1][0]), 0.0
    cuts = []
    for name, share in shares[:-1]:
        edge += share
        cuts.append((name, F.floor(F.col("_all") * F.lit(round(edge, 9)))))
    for name, cut in reversed(cuts):
        split = F.when(F.col("_r") < cut, name).otherwise(split)
    return ranked.withColumn("split", split).drop("_u", "_p", "_r", "_before", "_all")


def first_per_class(rows: DataFrame, n: int = 4, key: str = "route_id") -> DataFrame:
    """K5: the first ``n`` rows of each class."""
    w = Window.partitionBy("route_type").orderBy(key)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def with_source(synthetic: DataFrame, manual: DataFrame) -> DataFrame:
    """Both kinds of routes with their source; manual ones need coordinates."""
    tag = lambda df, name: df.withColumn("source", F.lit(name))
    return tag(synthetic, "synthetic").unionByName(tag(manual.where("x_coords is not null and y_coords is not null"), "manual"), allowMissingColumns=True)


def dataset_manifest(inventory: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.2)), seed: int = 42) -> DataFrame:
    """Split and new name of each labelled frame: ``<video>_<file>``."""
    rows = inventory.where("labelled").withColumn("new_name", F.concat_ws("_", "video", "stem"))
    return random_split(rows, shares, key="new_name", seed=seed).select("split", "new_name", "video", "stem")


def frame_inventory(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames by (video, stem) with whether a label of the same name exists."""
    have = labels.select("video", "stem").distinct().withColumn("_has", F.lit(True))
    return images.select("video", "stem").distinct().join(have, ["video", "stem"], "left").withColumn("labelled", F.coalesce("_has", F.lit(False))).drop("_has")
