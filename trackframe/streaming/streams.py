"""Detections as a stream: the batch filters, windowed counts, track lifetimes, stateful operators, sinks.

Frames become event time: ``event_ts`` = ``START`` + frame / fps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import FilterConfig, TrackerConfig
from ..operators import detections as d
from ..schemas import DETECTIONS
from .ordered import in_frame_order, online_links, steady_areas

__all__ = ["counts", "deduplicated", "filtered", "in_frame_order", "online_links", "read_detections", "run_once", "steady_areas", "track_lifetimes", "with_event_time", "write_batches"]


#: Time of frame 0, in microseconds.  Not the epoch itself, which is where watermarks begin: rows there would count as late.
START = 946_684_800_000_000


def read_detections(spark: SparkSession, path: str, fps: float = 30.0, files_a_batch: int = 1, schema: str = DETECTIONS) -> DataFrame:
    """Parquet files of detections as they arrive, with event time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return with_event_time(rows, fps)


def with_event_time(df: DataFrame, fps: float = 30.0) -> DataFrame:
    return df.withColumn("event_ts", F.timestamp_micros(F.floor(F.col("frame_id") * 1_000_000 / fps) + START))


def filtered(df: DataFrame, cfg: FilterConfig = FilterConfig(), tracker: TrackerConfig = TrackerConfig()) -> DataFrame:
    """ST1: the batch filters, unchanged, and box geometry."""
    return d.bbox_geometry(d.ghost_filter(d.zone_filter(d.filter_detections(df, cfg), cfg), tracker))


def counts(df: DataFrame, window: str = "10 seconds", slide: str | None = None, late: str = "5 seconds") -> DataFrame:
    """ST2: detections of each video in tumbling (or, with ``slide``, sliding) windows."""
    span = F.window("event_ts", window, slide) if slide else F.window("event_ts", window)
    return df.withWatermark("event_ts", late).groupBy("video_id", span.alias("w")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")).select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_confidence")


def track_lifetimes(df: DataFrame, cfg: TrackerConfig = TrackerConfig(), late: str = "5 seconds") -> DataFrame:
    """ST3: sessions of each track; a gap of the tracker's buffer ends one."""
    gap = f"{int(cfg.buffer_frames / cfg.fps * 1000)} milliseconds"
    return df.withWatermark("event_ts", late).groupBy("video_id", "track_id", F.session_window("event_ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame")).select("video_id", "track_id", "n", "first_frame", "last_frame")


def deduplicated(df: DataFrame, late: str = "5 seconds") -> DataFrame:
    """ST6: each detection once, however often it is delivered within the watermark."""
    return df.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["video_id", "det_id"])


def write_batches(df: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """ST7: every micro-batch appended to Parquet under its number, so that a replayed batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All available input through a query into a memory table (for tests and small results)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
