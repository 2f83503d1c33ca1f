"""Detection, route and label tables derived from the test tables, alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ROUTE_TYPES

_NAMES = ", ".join(f"'{r}'" for r in ROUTE_TYPES)

_US_SPARK = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
_US_DUCK = "(epoch_us(ts) - 1704067200000000)"

_DET = """SELECT CAST(user_id % 10 AS BIGINT) video_id, CAST(user_id AS BIGINT) track_id, CAST(event_id AS BIGINT) det_id,
  CAST(floor({US}/600000000) AS BIGINT) frame_id,
  CAST((CAST(round(value*100) AS BIGINT)*7) % 1920 AS DOUBLE) x, CAST((event_id*131+user_id*17) % 984 AS DOUBLE) y,
  CAST(10+event_id % 50 AS DOUBLE) width, CAST(20+(event_id*7) % 80 AS DOUBLE) height, CAST((event_id*13) % 100 AS DOUBLE)/100 confidence
FROM events"""
_DENSE = """SELECT CAST(0 AS BIGINT) video_id, CAST(event_id AS BIGINT) det_id, CAST(floor({US}/21600000000) AS BIGINT) frame_id,
  CAST((event_id*37) % 300 AS DOUBLE) x, CAST((event_id*59+user_id*17) % 200 AS DOUBLE) y,
  CAST(10+event_id % 50 AS DOUBLE) width, CAST(20+(event_id*7) % 80 AS DOUBLE) height, CAST((event_id*13) % 100 AS DOUBLE)/100 confidence
FROM events"""
_SEGMENTS = """SELECT CAST(user_id % 10 AS BIGINT) video_id, CAST(event_id AS BIGINT) line_id,
  CAST((event_id*37) % 1920 AS DOUBLE) x1, CAST((event_id*59) % 984 AS DOUBLE) y1,
  CAST((event_id*101+user_id*7) % 1920 AS DOUBLE) x2, CAST((event_id*211) % 984 AS DOUBLE) y2
FROM events"""
_MATCHES = """SELECT CAST(user_id % 2 AS BIGINT) video_id, CAST(floor({US}/86400000000) AS BIGINT) frame_id, CAST(event_id AS BIGINT) pt_id,
  CAST((event_id*37) % 1920 AS DOUBLE) px, CAST((event_id*59) % 984 AS DOUBLE) py,
  CAST((event_id*37) % 1920 AS DOUBLE)+3+((event_id*7) % 5-2)*CAST(0.25 AS DOUBLE)+CASE WHEN event_id % 10=0 THEN 80 ELSE 0 END cx,
  CAST((event_id*59) % 984 AS DOUBLE)-2+((event_id*11) % 5-2)*CAST(0.25 AS DOUBLE) cy
FROM events"""
_ROUTES_DUCK = f"""SELECT CAST(vec_id AS BIGINT) route_id, label::BIGINT label, ([{_NAMES}])[label+1] route_type,
  CASE WHEN vec_id % 5=0 THEN 'manual' ELSE 'synthetic' END source,
  list_transform(embedding, lambda v: greatest(least(0.5::DOUBLE+v::DOUBLE,1.0::DOUBLE),0.0::DOUBLE)) y_coords,
  list_transform(range(64), lambda k: k/63.0::DOUBLE) x_coords FROM embeddings"""
_ROUTES_SPARK = f"""SELECT CAST(vec_id AS BIGINT) route_id, CAST(label AS BIGINT) label, element_at(array({_NAMES}), label+1) route_type,
  CASE WHEN vec_id % 5=0 THEN 'manual' ELSE 'synthetic' END source,
  transform(embedding, v -> greatest(least(0.5D+CAST(v AS DOUBLE),1D),0D)) y_coords,
  transform(sequence(0,63), k -> k/63D) x_coords FROM embeddings"""

#: SQL of every fixture for the oracle, as common table expressions.
CTES = {
    "det": _DET.format(US=_US_DUCK),
    # One row for each track and frame, for operators that divide by the time between rows.
    "det1": "SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY video_id, track_id, frame_id ORDER BY det_id) = 1",
    # Fragments of tracks, for merging.
    "frag": "SELECT video_id, track_id*100 + frame_id // 400 AS track_id, det_id, frame_id, x, y, width, height, confidence FROM det",
    "det_dense": _DENSE.format(US=_US_DUCK),
    "segments": _SEGMENTS,
    "matches": _MATCHES.format(US=_US_DUCK),
    "routes": _ROUTES_DUCK,
    "videos": "SELECT video_id, 1920.0::DOUBLE width, 984.0::DOUBLE height, 30.0::DOUBLE fps, max(frame_id)+1 AS total_frames FROM det GROUP BY video_id",
    "route_labels": "SELECT route_id AS track_id, 'v' || (route_id % 7) AS source_video, route_type, 'hand' AS labeler, CAST(1 + route_id % 5 AS INTEGER) AS confidence, CAST(NULL AS VARCHAR) AS notes FROM routes WHERE route_id % 3 <> 0",
    "predictions": "SELECT m.model, route_id, label, (label + CASE WHEN (route_id + m.model) % 7 = 0 THEN 1 ELSE 0 END) % 10 AS pred FROM routes, (SELECT unnest([0,1,2,3])::BIGINT AS model) m",
}


def oracle(body: str, *tables: str) -> str:
    """A full SQL text: the named fixtures (and what they need) in front of ``body``."""
    needs = {"det1": ["det"], "frag": ["det"], "videos": ["det"], "route_labels": ["routes"], "predictions": ["routes"]}
    wanted = {x for t in tables for x in [t, *needs.get(t, [])]}
    ctes = ", ".join(f"{t} AS ({CTES[t]})" for t in CTES if t in wanted)
    body = body.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"WITH {ctes} {body}"


class Fixtures:
    """The same tables as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, text: str, name: str) -> DataFrame:
        return self.spark.sql(text.replace(f"FROM {name}", "FROM {t}"), t=self.table(name))

    @property
    def det(self) -> DataFrame:
        return self._sql(_DET.format(US=_US_SPARK), "events")

    @property
    def det1(self) -> DataFrame:
        from .operators.tracks import one_per_frame

        return one_per_frame(self.det)

    @property
    def frag(self) -> DataFrame:
        return self.det.withColumn("track_id", F.col("track_id") * 100 + F.expr("frame_id div 400"))

    @property
    def det_dense(self) -> DataFrame:
        return self._sql(_DENSE.format(US=_US_SPARK), "events")

    @property
    def segments(self) -> DataFrame:
        return self._sql(_SEGMENTS, "events")

    @property
    def matches(self) -> DataFrame:
        return self._sql(_MATCHES.format(US=_US_SPARK), "events")

    @property
    def routes(self) -> DataFrame:
        return self._sql(_ROUTES_SPARK, "embeddings")

    @property
    def videos(self) -> DataFrame:
        return self.det.groupBy("video_id").agg(F.lit(1920.0).alias("width"), F.lit(984.0).alias("height"), F.lit(30.0).alias("fps"), (F.max("frame_id") + 1).alias("total_frames"))

    @property
    def route_labels(self) -> DataFrame:
        return self.routes.where("route_id % 3 <> 0").selectExpr("route_id AS track_id", "concat('v', route_id % 7) AS source_video", "route_type", "'hand' AS labeler", "CAST(1 + route_id % 5 AS INT) AS confidence", "CAST(NULL AS STRING) AS notes")

    @property
    def predictions(self) -> DataFrame:
        models = self.routes.select("route_id", "label", F.explode(F.array(*(F.lit(m).cast("bigint") for m in range(4)))).alias("model"))
        return models.selectExpr("model", "route_id", "label", "(label + CASE WHEN (route_id + model) % 7 = 0 THEN 1 ELSE 0 END) % 10 AS pred")
