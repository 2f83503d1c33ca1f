"""Queries that write the given tables through a sink and read them back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import files
from ..storage import fresh_path
from .catalog import query, rounded
from .route_queries import DOTS_SQL


@query("s4_s5_trajectory_store", "det", sql="SELECT video_id, track_id, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_id, det_id) - 1 AS det_id, frame_id, x, y, width, height, confidence FROM det")
def _(f):
    path = fresh_path(f.spark, "store")
    files.write_trajectories(f.det, path)
    return files.read_store(f.spark, path)


@query("s3_nested_trajectory_files", "det", sql="SELECT track_id, count(*) AS num_detections, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS boxes FROM det GROUP BY video_id, track_id")
def _(f):
    path = fresh_path(f.spark, "nested")
    files.write_trajectories(f.det, path)
    found = files.read_trajectories(f.spark, path, glob="*.json", nested=True)
    return found.select("track_id", "num_detections", F.element_at("frame_range", 1).alias("first_frame"), F.element_at("frame_range", 2).alias("last_frame"), F.size("detections").cast("bigint").alias("boxes"))


@query("s7_pipeline_results", "det", sql="""SELECT 'classified' AS part, CAST(video_id AS VARCHAR) AS name, count(*) AS n FROM (SELECT DISTINCT video_id, track_id FROM det) GROUP BY 2 UNION ALL SELECT 'los', CAST(video_id AS VARCHAR), 1 FROM det GROUP BY video_id
  UNION ALL SELECT 'skill', 'video_' || video_id, count(*) FROM (SELECT DISTINCT video_id, track_id FROM det) WHERE track_id % 3 = 0 GROUP BY 2 UNION ALL SELECT 'statistics', 'tracks', count(*) FROM (SELECT DISTINCT video_id, track_id FROM det)""")
def _(f):
    path = fresh_path(f.spark, "results")
    tracks = f.det.select("video_id", "track_id").distinct()
    skill = tracks.withColumn("is_skill", F.col("track_id") % 3 == 0)
    files.write_pipeline_results(path, tracks.withColumn("team", F.lit("offense")), tracks.groupBy("video_id").agg(F.lit(100.0).alias("x_value")), skill, tracks.agg(F.count("*").alias("tracks")))
    read = lambda name: f.spark.read.parquet(f"{path}/{name}")
    count = lambda part, df, name: df.groupBy(name.cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    out = count("classified", read("classified"), F.col("video_id")).unionByName(count("los", read("los"), F.col("video_id"))).unionByName(count("skill", read("all_skill_positions"), F.col("source_video")))
    return out.unionByName(read("extraction_statistics").select(F.lit("statistics").alias("part"), F.lit("tracks").alias("name"), F.col("tracks").alias("n")))


@query("s9_limited_tracks", "det", sql="""WITH t AS (SELECT video_id, track_id, count(*) c, max(frame_id) f FROM det GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY c DESC, track_id) <= 5 AS kept FROM t)
  SELECT video_id, count(*) FILTER (kept) AS n, sum(track_id) FILTER (kept)::BIGINT AS ids, count(*) AS original, count(*) FILTER (NOT kept) AS dropped, min(c) FILTER (kept) AS least FROM k GROUP BY 1""")
def _(f):
    """The five longest tracks of each video and what the limit did, through the sink and back."""
    path = fresh_path(f.spark, "tracks")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("c"), "track_id"))
    ranked = f.det.groupBy("video_id", "track_id").agg(F.count("*").alias("c")).withColumn("kept", rank <= 5)
    stats = ranked.groupBy("video_id").agg(F.count("*").alias("original"), F.count_if(~F.col("kept")).alias("dropped"), F.min(F.when(F.col("kept"), F.col("c"))).alias("least"))
    target = files.write_limited(ranked.where("kept").drop("kept", "c"), stats, path, in_place=True)
    back = f.spark.read.parquet(f"{path}_limited/tracks").groupBy(F.col("video_id").cast("bigint").alias("video_id")).agg(F.count("*").alias("n"), F.sum("track_id").alias("ids"))
    return back.join(f.spark.read.parquet(f"{target}/stats"), "video_id")


@query("s1_s2_trajectory_files", "det", sql="""SELECT 'good' AS kind, count(DISTINCT (video_id, track_id)) AS tracks, count(*) AS boxes, sum(frame_id)::BIGINT AS frames FROM det UNION ALL SELECT 'bad', (SELECT count(DISTINCT video_id) FROM det), 0, 0""")
def _(f):
    """Files of trajectories, and beside those of each video one that is no JSON: the good are read, the bad are set aside by name."""
    path = fresh_path(f.spark, "files")
    files.write_trajectories(f.det, path)
    f.det.select("video_id", F.lit("{spoiled").alias("value")).distinct().write.partitionBy("video_id").mode("append").text(path)
    rows = files.read_trajectory_files(f.spark, path, glob="part-*")
    good, bad = files.split_corrupt(rows)
    boxes = files.flat_detections(files.read_trajectories(f.spark, path, glob="part-*").select("video_name", "track_id", "detections"))
    counted = boxes.agg(F.count("*").alias("boxes"), F.sum("frame_id").alias("frames"))
    tracks = good.agg(F.sum(F.size("trajectories")).cast("bigint").alias("tracks"))
    one = tracks.crossJoin(F.broadcast(counted)).select(F.lit("good").alias("kind"), "tracks", "boxes", "frames")  # one row each
    return one.unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("tracks"), F.lit(0).cast("bigint").alias("boxes"), F.lit(0).cast("bigint").alias("frames")))


@query("s10_route_store", "routes", sql="SELECT route_id, route_type, 70 AS n, round(list_sum(y_coords) + 6*y_coords[64], 6) AS total FROM routes")
def _(f):
    path = fresh_path(f.spark, "routes")
    files.write_routes(f.routes, path)
    return rounded(files.read_routes(f.spark, path, 70).select("route_id", "route_type", F.size("x_coords").cast("bigint").alias("n"), F.aggregate("y_coords", F.lit(0.0), lambda s, v: s + v).alias("total")))


@query("s11_training_set", "routes", sql="""WITH c AS (SELECT route_type, row_number() OVER (ORDER BY route_type) - 1 AS class_index FROM (SELECT DISTINCT route_type FROM routes))
  SELECT route_id, class_index, 128 AS n, round(list_sum(list_transform(list_concat(x_coords, y_coords), lambda v: v::FLOAT::DOUBLE)), 4) AS total FROM routes JOIN c USING (route_type)""")
def _(f):
    path = fresh_path(f.spark, "training")
    files.write_training_set(f.routes, path)
    features = f.spark.read.parquet(f"{path}/features")
    return rounded(features.select("route_id", "class_index", F.size("features").cast("bigint").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, v: s + v.cast("double")).alias("total")), 4)


@query("s12_labels", "route_labels", sql="SELECT track_id, source_video, route_type, labeler, confidence, notes, (SELECT count(*) FROM route_labels) AS total_labels, (SELECT count(DISTINCT route_type) FROM route_labels) AS classes FROM route_labels")
def _(f):
    path = fresh_path(f.spark, "labels")
    files.write_labels(f.route_labels, path)
    (totals,) = f.spark.read.json(f"{path}/metadata").collect()
    return files.read_labels(f.spark, path).select("*", F.lit(totals.total_labels).cast("bigint").alias("total_labels"), F.lit(len(totals.classes)).cast("bigint").alias("classes"))


#: Every pixel's colour as hexadecimal digits, channel by channel.
_IMAGES = DOTS_SQL + """, px AS (SELECT route_id, i, coalesce(kind, 0) AS kind FROM (SELECT route_id, unnest(range(4096)) i FROM routes) LEFT JOIN (SELECT route_id, r*64+c AS i, kind FROM dots) USING (route_id, i)),
  ink AS (SELECT route_id, list(kind ORDER BY i) g FROM px GROUP BY route_id),
  k AS (SELECT route_type, row_number() OVER (ORDER BY route_type) - 1 AS class_index FROM (SELECT DISTINCT route_type FROM routes))
  SELECT route_id, class_index, count(*) OVER (PARTITION BY route_type, source) AS n, sha256(array_to_string(list_transform(g, lambda v: ['FF', '1E', '00', 'DC'][v+1]), '')
    || array_to_string(list_transform(g, lambda v: ['FF', '64', 'D2', '1E'][v+1]), '') || array_to_string(list_transform(g, lambda v: ['FF', 'FF', '00', '1E'][v+1]), '')) AS image_sha256
  FROM ink JOIN routes USING (route_id) JOIN k USING (route_type)"""


@query("s14_route_images", "routes", sql=_IMAGES)
def _(f):
    path = fresh_path(f.spark, "images")
    files.write_images(f.routes, path)
    images = f.spark.read.parquet(f"{path}/images").select("route_id", F.col("class_index").cast("bigint").alias("class_index"), F.sha2(F.hex("image"), 256).alias("image_sha256"))
    counts = f.spark.read.parquet(f"{path}/summary")
    return images.join(f.routes.select("route_id", "route_type", "source"), "route_id").join(counts, ["route_type", "source"]).select("route_id", "class_index", "n", "image_sha256")
