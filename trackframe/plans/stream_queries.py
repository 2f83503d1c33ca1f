"""Streaming operators over the events table, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TrackerConfig
from ..storage import fresh_path
from ..streaming import streams as st
from .box_queries import _KEEP, _STEADY
from .catalog import query, rounded


def _source(f) -> DataFrame:
    """The detections in files of a stream source, in the shared folder."""
    path = fresh_path(f.spark, "stream")
    _columns(f.det).repartitionByRange(4, "frame_id").write.parquet(path)
    return st.read_detections(f.spark, path, files_a_batch=4)


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select("video_id", "track_id", "det_id", "frame_id", "x", "y", "width", "height", "confidence")


def _through(f, df: DataFrame) -> DataFrame:
    """The stream's output, written by the batch sink and read back."""
    base = fresh_path(f.spark, "out")
    f.spark.createDataFrame([], df.schema).write.parquet(f"{base}/data/batch=-1")
    st.write_batches(df, f"{base}/data", f"{base}/state").awaitTermination()
    return f.spark.read.schema(df.schema).parquet(f"{base}/data").select(*df.columns)


@query("st1_stream_filter", "det", sql=f"""SELECT det_id, width*height AS area FROM det WHERE {_KEEP} AND confidence >= 0.1 AND CASE WHEN y+height/2 >= 734 THEN width*height BETWEEN 350 AND 10000 WHEN y+height/2 <= 250 THEN true ELSE width*height BETWEEN 250 AND 7500 END""")
def _(f):
    return _through(f, st.filtered(_source(f)).select("det_id", "area"))


#: Event time of det in microseconds, and the watermark that one batch of all of it leaves.
_TIMES = """WITH t AS (SELECT *, floor(frame_id*1000000/30.0::DOUBLE)::BIGINT + 946684800000000 us FROM det), w AS (SELECT (max(us)//1000)*1000 - 5000000 mark FROM t)"""


@query("st6_stream_deduplicate", "det", sql=_TIMES + " SELECT det_id FROM det UNION ALL SELECT -det_id FROM t, w WHERE det_id % 7 = 0 AND us > mark")
def _(f):
    """After all detections come some of them again, then new ones of old frames, which are kept within the watermark only."""
    path = fresh_path(f.spark, "stream")
    for part in (f.det, f.det.where("det_id % 5 = 0"), f.det.where("det_id % 7 = 0").withColumn("det_id", -F.col("det_id"))):
        _columns(part).coalesce(1).write.mode("append").parquet(path)
    return _through(f, st.deduplicated(st.read_detections(f.spark, path)).select("det_id"))


def _shuffled(f, rows: DataFrame, parts: int = 6, jitter: int = 120, fps: float = 30.0) -> DataFrame:
    """The boxes in files that arrive one after another; a box comes up to ``jitter`` frames after later ones."""
    path = fresh_path(f.spark, "stream")
    due = F.col("frame_id") + F.pmod(F.xxhash64("det_id"), F.lit(jitter))
    low, high = rows.agg(F.min(due), F.max(due)).first()
    for k in range(parts):
        edge = lambda i: low + (high + 1 - low) * i // parts
        # One file, whatever its size: of several the first would move the watermark past boxes of the others.
        _columns(rows.where((due >= edge(k)) & (due < edge(k + 1)))).repartition(1).sortWithinPartitions(F.xxhash64("det_id", F.lit(7))).write.mode("append").parquet(path)
    return st.read_detections(f.spark, path, fps)


#: What the watermark has passed at the end of the input.
_PASSED = "((us + 999)//1000)*1000 <= mark"


@query("st4_stream_steady_areas", "det", sql=_STEADY + f", {_TIMES[5:]} SELECT det_id, round(r.width, 6) AS width, round(r.height, 6) AS height FROM r JOIN t USING (det_id), w WHERE k > 0 AND {_PASSED}")
def _(f):
    return rounded(_through(f, st.steady_areas(_shuffled(f, f.det))).select("det_id", "width", "height"))


@query("st6_stream_in_frame_order", "det", sql=_TIMES + f" SELECT video_id, det_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id, det_id) AS place FROM t, w WHERE {_PASSED}")
def _(f):
    return _through(f, st.in_frame_order(_shuffled(f, f.det))).select("video_id", "det_id", "place")


def _many_videos(f) -> DataFrame:
    """Crowded frames of several videos."""
    return f.det_dense.withColumns({"track_id": F.col("det_id"), "video_id": F.col("det_id") % 12})


@query("st5_stream_links")
def _(f):
    return _through(f, st.online_links(_shuffled(f, _many_videos(f), jitter=4, fps=1.0), TrackerConfig(fps=1.0)))


def _windows_sql(size: int, slide: int) -> str:
    return f"""{_TIMES}, s AS (SELECT video_id, confidence, (us // {slide}000000 - k)*{slide}000000 AS start_us FROM t, (SELECT unnest(range({size // slide})) k))
  SELECT video_id, start_us, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM s, w WHERE start_us + {size}000000 <= mark GROUP BY 1, 2"""


def _windows(f, *window: str):
    found = _through(f, st.counts(_source(f), *window))
    return rounded(found.select("video_id", F.unix_micros("start").alias("start_us"), "n", "mean_confidence"))


@query("st2_stream_counts", "det", sql=_windows_sql(10, 10))
def _(f):
    return _windows(f)


@query("st2_stream_sliding_counts", "det", sql=_windows_sql(20, 10))
def _(f):
    return _windows(f, "20 seconds", "10 seconds")


@query("st3_stream_track_lifetimes", "det", sql=_TIMES + """, d AS (SELECT *, CASE WHEN us > lag(us) OVER p + 1000000 THEN 1 ELSE 0 END new FROM t WINDOW p AS (PARTITION BY video_id, track_id ORDER BY us)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY video_id, track_id ORDER BY us) session FROM d)
  SELECT video_id, track_id, count(*) AS n, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM s, w GROUP BY video_id, track_id, session, mark HAVING max(us) + 1000000 <= mark""")
def _(f):
    return _through(f, st.track_lifetimes(_source(f)))
