"""Files of trajectories, routes, labels and video facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..schemas import TRAJECTORY_FILE


def without_aggregates(files: DataFrame, column: str = "file_name", ignore_case: bool = True) -> DataFrame:
    """Drop files that hold the results of many videos."""
    return files.where(~names.is_aggregate(F.col(column), ignore_case))


def read_trajectory_files(spark: SparkSession, path: str, glob: str = "*_trajectories.json", nested: bool = False) -> DataFrame:
    """A row for each file: video_name, file, metadata, trajectories, _corrupt_record.

    ``nested`` looks one folder deeper and takes each sub-folder's first file.
    Bad files keep their text in ``_corrupt_record``; see :func:`split_corrupt`.
    """
    reader = spark.read.schema(TRAJECTORY_FILE).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob)
    rows = (reader.option("recursiveFileLookup", True) if nested else reader).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    rows = rows.withColumn("video_name", names.video_of(F.col("file")))
    if nested:
        folder = F.regexp_replace("file", "/[^/]*$", "")
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(folder).orderBy("file"))).where("_k = 1").drop("_k")
    return rows


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good files, and the names of bad ones."""
    return rows.where("trajectories is not null"), rows.where("trajectories is null").select("file", "_corrupt_record")


def read_trajectories(spark: SparkSession, path: str, glob: str = "*_trajectories.json", nested: bool = False) -> DataFrame:
    """A row for each trajectory of the good files, missing fields filled in.

    A file without picture sizes gets the first box's right and lower end.
    """
    good, _ = split_corrupt(read_trajectory_files(spark, path, glob, nested))
    rows = good.select("video_name", F.explode("trajectories").alias("t")).select("video_name", "t.*")
    first = F.element_at("detections", 1)
    fill = {
        "num_detections": F.coalesce("num_detections", F.size("detections").cast("bigint")),
        "team": F.coalesce("team", F.lit("unknown")), "is_skill_position": F.coalesce("is_skill_position", F.lit(False)),
        "total_distance": F.coalesce("total_distance", F.lit(0.0)), "displacement": F.coalesce("displacement", F.lit(0.0)),
        "video_width": F.coalesce("video_width", F.when(F.size("detections") > 0, first["x"] + first["width"])),
        "video_height": F.coalesce("video_height", F.when(F.size("detections") > 0, first["y"] + first["height"])),
    }
    return rows.withColumns(fill)


def flat_detections(trajectories: DataFrame) -> DataFrame:
    """A row for each detection of read trajectories; confidence defaults to 1."""
    rows = trajectories.select("video_name", "track_id", F.posexplode("detections").alias("det_id", "d")).select("video_name", "track_id", F.col("det_id").cast("bigint").alias("det_id"), "d.*")
    return rows.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "center_x": F.coalesce("center_x", F.col("x") + F.col("width") / 2), "center_y": F.coalesce("center_y", F.col("y") + F.col("height") / 2)})


def nested_trajectories(df: DataFrame) -> DataFrame:
    """A row for each video: counts and its trajectories with summary and detections."""
    from ..operators.tracks import track_summary

    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    item = F.struct("frame_id", "x", "y", "width", "height", cx.alias("center_x"), cy.alias("center_y"), "confidence")
    dets = df.groupBy("video_id", "track_id").agg(F.sort_array(F.collect_list(F.struct("frame_id", "det_id", item.alias("d")))).alias("_d"))
    rows = dets.join(track_summary(df), ["video_id", "track_id"]).select(
        "video_id", F.struct("track_id", "num_detections", F.array("first_frame", "last_frame").alias("frame_range"), "total_distance", "displacement", F.transform("_d", lambda s: s["d"]).alias("detections")).alias("t")
    )
    per = rows.groupBy("video_id").agg(F.sort_array(F.collect_list("t")).alias("trajectories"))
    total = F.aggregate("trajectories", F.lit(0).cast("bigint"), lambda s, t: s + t["num_detections"])
    return per.select("video_id", F.struct(F.size("trajectories").cast("bigint").alias("num_trajectories"), total.alias("total_detections"), F.try_divide(total, F.size("trajectories")).alias("average_detections")).alias("metadata"), "trajectories")


def write_trajectories(df: DataFrame, path: str) -> None:
    """JSON lines of nested trajectories, a folder for each video."""
    nested_trajectories(df).write.mode("overwrite").partitionBy("video_id").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_trajectories` wrote, as detections again (ids by order within the track)."""
    rows = spark.read.schema(TRAJECTORY_FILE.replace(", _corrupt_record string", ", video_id bigint")).json(path)
    flat = rows.select("video_id", F.explode("trajectories").alias("t")).select("video_id", "t.track_id", F.posexplode("t.detections").alias("det_id", "d"))
    return flat.select("video_id", "track_id", F.col("det_id").cast("bigint").alias("det_id"), "d.frame_id", "d.x", "d.y", "d.width", "d.height", "d.confidence")


def write_pipeline_results(path: str, teams: DataFrame, los: DataFrame, skill: DataFrame, statistics: DataFrame) -> None:
    """Classified tracks, lines, skill players (each with its video) and statistics as Parquet tables."""
    teams.write.mode("overwrite").partitionBy("video_id").parquet(f"{path}/classified")
    los.write.mode("overwrite").parquet(f"{path}/los")
    skill.where("is_skill").withColumn("source_video", F.concat(F.lit("video_"), F.col("video_id"))).write.mode("overwrite").parquet(f"{path}/all_skill_positions")
    statistics.write.mode("overwrite").parquet(f"{path}/extraction_statistics")


def write_limited(limited: DataFrame, stats: DataFrame, path: str, in_place: bool = False) -> str:
    """Limited tracks and statistics; in place means beside the input, with a suffix.  Returns the folder."""
    target = f"{path}_limited" if in_place else path
    limited.write.mode("overwrite").partitionBy("video_id").parquet(f"{target}/tracks")
    stats.write.mode("overwrite").parquet(f"{target}/stats")
    return target


def write_routes(routes: DataFrame, path: str) -> None:
    """Normalised routes."""
    routes.write.mode("overwrite").parquet(path)


def read_routes(spark: SparkSession, path: str, n: int = 64) -> DataFrame:
    """Routes with coordinates continued to ``n`` points."""
    from ..operators.routes import padded

    return padded(spark.read.parquet(path), n)


def write_training_set(routes: DataFrame, path: str, n: int = 64) -> None:
    """Full routes, padded features with class index, classes and a summary."""
    from ..operators.metrics import samples_per_class
    from ..operators.routes import padded

    classes = samples_per_class(routes)
    routes.write.mode("overwrite").parquet(f"{path}/routes")
    classes.write.mode("overwrite").parquet(f"{path}/classes")
    rows = padded(routes, n).join(classes.select("route_type", "class_index"), "route_type")
    rows.select("route_id", F.concat("x_coords", "y_coords").cast("array<float>").alias("features"), "class_index").write.mode("overwrite").parquet(f"{path}/features")
    samples_per_class(routes, by="source").write.mode("overwrite").parquet(f"{path}/summary")


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels, and one row of totals with the distinct classes."""
    labels.write.mode("overwrite").json(f"{path}/labels")
    labels.agg(F.count("*").alias("total_labels"), F.sort_array(F.collect_set("route_type")).alias("classes")).write.mode("overwrite").json(f"{path}/metadata")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    from ..schemas import LABELS

    return spark.read.schema(LABELS).json(f"{path}/labels")


def write_images(routes: DataFrame, path: str, size: int = 64) -> None:
    """A dense picture of each route with its class index, and counts by class and source."""
    from ..operators.images import route_images

    classes = routes.select("route_type").distinct().withColumn("class_index", F.row_number().over(Window.orderBy("route_type")) - 1)  # a row for each class
    labelled = routes.select("route_id", "route_type").join(F.broadcast(classes), "route_type")
    route_images(routes, size).join(labelled, "route_id").write.mode("overwrite").parquet(f"{path}/images")
    routes.groupBy("route_type", "source").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/summary")


def labelled_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames below ``path/<video>/`` and whether a text file of the same name lies beside them; contents are not read."""
    from ..operators.labels import frame_inventory

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("video"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"))
    return frame_inventory(named.where("kind in ('jpg', 'jpeg')"), named.where("kind = 'txt'"))


def video_manifest(videos: DataFrame) -> DataFrame:
    """Files of known kinds with duration (0 without a frame rate) and codec as four characters."""
    code = F.concat(*(F.char(F.shiftright("fourcc", 8 * k).bitwiseAND(255)) for k in range(4)))
    known = videos.where(F.lower("file").rlike(r"\.(mp4|avi|mov|mkv)$"))
    return known.withColumns({"duration": F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")).otherwise(0.0), "codec": code})
